"""What a plan did, read from its own metrics after it has run."""


def nodes(df):
    """All nodes of the executed plan, query stages opened. Runs the plan."""
    plan = df._jdf.queryExecution().executedPlan()
    plan.executeCollect()
    out, todo = [], [plan]
    while todo:
        p = todo.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif kind in ("ShuffleQueryStageExec", "BroadcastQueryStageExec", "TableCacheQueryStageExec", "ResultQueryStageExec"):
            todo.append(p.plan())
        else:
            out.append((kind, p))
            children = p.children()
            todo += [children.apply(i) for i in range(children.size())]
    return out


def metric(p, name):
    found = p.metrics().get(name)
    return found.get().value() if found.isDefined() else None


def total(df, kind, name):
    return sum(metric(p, name) or 0 for k, p in nodes(df) if k == kind)


def count(df, kind):
    return sum(k == kind for k, _ in nodes(df))
