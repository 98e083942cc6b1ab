"""Reading physical plans."""


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()
