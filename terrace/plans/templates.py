"""Ready-made flows by name."""

from __future__ import annotations

from copy import deepcopy

# Step orders and settings of the templates and goals users pick by name.
_TIDY = {"stripWhitespace": True, "deduplicate": True, "fillNulls": False}
_TIDY_ZERO = {"stripWhitespace": True, "deduplicate": True, "fillNulls": True, "fillNullsValue": "0"}
_MONTHLY = "total = SUM(amount)\ncount = COUNT(*)\navg = AVG(amount)"
_KPIS = "min = MIN(amount)\nmax = MAX(amount)\navg = AVG(amount)\nsum = SUM(amount)\ncount = COUNT(*)"

TEMPLATES = {
    "raw-bronze": [("SOURCE", {}), ("OUTPUT", {"outputLayer": "BRONZE"})],
    "quick-clean": [("SOURCE", {}), ("CLEAN", _TIDY), ("OUTPUT", {"outputLayer": "SILVER"})],
    "aggregation": [
        ("SOURCE", {}), ("CLEAN", _TIDY), ("AGGREGATE", {}), ("OUTPUT", {"outputLayer": "GOLD"}),
    ],
    "medallion": [
        ("SOURCE", {}),
        ("OUTPUT", {"outputLayer": "BRONZE"}),
        ("CLEAN", _TIDY),
        ("OUTPUT", {"outputLayer": "SILVER"}),
        ("AGGREGATE", {}),
        ("OUTPUT", {"outputLayer": "GOLD"}),
    ],
    "full-etl": [
        ("SOURCE", {}), ("CLEAN", _TIDY), ("VALIDATE", {"validationMode": "flag"}),
        ("TRANSFORM", {}), ("FILTER", {}), ("OUTPUT", {"outputLayer": "SILVER"}),
    ],
    "join-enrich": [
        ("SOURCE", {}), ("JOIN", {"joinType": "INNER"}), ("TRANSFORM", {}),
        ("OUTPUT", {"outputLayer": "SILVER"}),
    ],
    "gold-monthly": [
        ("SOURCE", {}), ("CLEAN", _TIDY),
        ("AGGREGATE", {"groupBy": "month", "aggregations": _MONTHLY}),
        ("OUTPUT", {"outputLayer": "GOLD"}),
    ],
    "gold-top10": [
        ("SOURCE", {}), ("CLEAN", _TIDY), ("AGGREGATE", {}), ("SORT", {"sortDirection": "DESC"}),
        ("FILTER", {"filterCondition": "LIMIT 10"}), ("OUTPUT", {"outputLayer": "GOLD"}),
    ],
    "gold-status": [
        ("SOURCE", {}), ("CLEAN", _TIDY), ("CATEGORIZE", {}), ("AGGREGATE", {}),
        ("OUTPUT", {"outputLayer": "GOLD"}),
    ],
    "gold-kpi": [
        ("SOURCE", {}), ("CLEAN", _TIDY), ("AGGREGATE", {"aggregations": _KPIS}),
        ("OUTPUT", {"outputLayer": "GOLD"}),
    ],
}

GOALS = {
    "clean": [("SOURCE", {}), ("CLEAN", _TIDY_ZERO), ("OUTPUT", {"outputLayer": "SILVER"})],
    "monthly-report": [
        ("SOURCE", {}), ("CLEAN", _TIDY),
        ("AGGREGATE", {"groupBy": "Status", "aggregations": _MONTHLY}),
        ("OUTPUT", {"outputLayer": "GOLD"}),
    ],
    "validate": [
        ("SOURCE", {}),
        ("CLEAN", {"stripWhitespace": True, "deduplicate": False, "fillNulls": False}),
        ("VALIDATE", {
            "validationRules":
                "NOT_NULL:Bank_Ref\nNUMBER:Difference,min=0\nDATE:Transaction_Date",
            "validationMode": "flag",
        }),
        ("OUTPUT", {"outputLayer": "SILVER"}),
    ],
    "dashboard-ready": [
        ("SOURCE", {}), ("CLEAN", _TIDY_ZERO),
        ("AGGREGATE", {
            "groupBy": "Status",
            "aggregations": "total = SUM(amount)\ncount = COUNT(*)\nmin = MIN(amount)\n"
                            "max = MAX(amount)\navg = AVG(amount)",
        }),
        ("OUTPUT", {"outputLayer": "GOLD"}),
    ],
}


def template(name: str, settings: dict[str, dict] | None = None, table: str | None = None) -> list[dict]:
    """Steps of a template or goal, with settings per step type merged in.

    ``table`` names the outputs; with several outputs the layer is added in front.
    """
    chosen = TEMPLATES.get(name) or GOALS.get(name)
    if chosen is None:
        raise ValueError(f"unknown template {name!r}")
    outputs = sum(kind == "OUTPUT" for kind, _ in chosen)
    steps = []
    for order, (kind, defaults) in enumerate(chosen, 1):
        config = {**deepcopy(defaults), **(settings or {}).get(kind, {})}
        step = {"type": kind, "order": order, "config": config}
        if kind == "OUTPUT":
            layer = config.setdefault("outputLayer", "SILVER")
            base = table or config.get("outputTable") or "output"
            step["outputLayer"] = layer
            step["outputTable"] = f"{layer.lower()}_{base}" if outputs > 1 else base
        steps.append(step)
    return steps
