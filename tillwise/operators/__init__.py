"""DataFrame operators: ``op(df, …) -> DataFrame``; none of them collects."""
