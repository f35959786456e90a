"""DataFrame -> DataFrame operators on signal frames."""
