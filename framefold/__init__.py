"""framefold: focus-stack analytics and corpus preparation as Spark DataFrame operators."""
