"""Log fusion and behaviour-graph analytics as DataFrame operators on Spark."""
