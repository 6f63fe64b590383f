"""VALIDATE: declarative row rules that flag rows or take them out."""

from __future__ import annotations

import logging
from itertools import groupby

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrace import constants as K
from terrace.functions.dates import parse_date, parse_with_format
from terrace.functions.names import as_list, col, dtype_of, is_time, option, resolve_column
from terrace.functions.numbers import as_ledger_number, as_number
from terrace.functions.text import is_blank
from terrace.operators.quantiles import iqr_fences, outside

log = logging.getLogger("terrace")
_CHECK = "__check_"


# --- rule text ----------------------------------------------------------------------------------


def parse_rules(rules) -> list[dict]:
    """Rules as dictionaries. Text holds one ``TYPE:parameters`` rule per line."""
    if not isinstance(rules, str):
        return list(rules or [])
    parsed = []
    for line in rules.splitlines():
        kind, colon, rest = line.strip().partition(":")
        reader = _READERS.get(kind.upper())
        rule = reader(rest) if colon and reader and rest.strip() else None
        if rule:
            parsed.append({"type": kind.upper(), **rule})
    return parsed


def _named(parts: list[str]) -> dict[str, str]:
    pairs = (p.partition("=") for p in parts if "=" in p)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _after(text: str, key: str) -> str:
    return text.split(key, 1)[1].strip() if key in text else ""


def _compare_rule(rest):
    first, *others = as_list(rest)
    if not others:
        return None
    tolerance = float(others[1]) if len(others) > 1 else 0
    return {"col1": first, "col2": others[0], "tolerance": tolerance}


def _number_rule(rest):
    name, *parts = as_list(rest)
    return {"column": name, **{k: float(v) for k, v in _named(parts).items()}}


def _date_rule(rest):
    name, *parts = as_list(rest)
    named = _named(parts)
    bare = next((p for p in reversed(parts) if "=" not in p), None)
    return {"column": name, "format": named.get("format", bare), "locale": named.get("locale")}


def _regex_rule(rest):
    name, comma, tail = rest.partition(",")
    return {"column": name.strip(), "pattern": _after(tail, "pattern=")} if comma else None


def _enum_rule(rest):
    name, comma, tail = rest.partition(",")
    return {"column": name.strip(), "values": as_list(_after(tail, "values="))} if comma else None


def _outlier_rule(rest):
    name, *parts = as_list(rest)
    named = _named(parts)
    return {
        "column": name,
        "method": named.get("method", "iqr").lower(),
        "threshold": float(named.get("threshold", K.ZSCORE_THRESHOLD)),
    }


_READERS = {
    "NOT_NULL": lambda rest: {"column": as_list(rest)[0]},
    "COMPARE": _compare_rule,
    "NUMBER": _number_rule,
    "DATE": _date_rule,
    "UNIQUE": lambda rest: {"column": rest.strip()},
    "REGEX": _regex_rule,
    "ENUM": _enum_rule,
    "OUTLIER": _outlier_rule,
}


# --- checks ---------------------------------------------------------------------------------------


class _Checked:
    """A frame under validation: failed checks are boolean columns added to it, in rule order.

    Checks are columns, not expressions, because NUMBER and DATE replace the column that later
    rules look at.
    """

    def __init__(self, df: DataFrame):
        self.df = df
        self.columns = df.columns
        self.messages: list[str] = []

    def column(self, rule: dict, key: str = "column") -> str | None:
        return resolve_column(self.columns, rule.get(key))

    def add(self, failed: Column, message: str) -> None:
        name = f"{_CHECK}{len(self.messages)}"
        self.df = self.df.withColumn(name, F.coalesce(failed, F.lit(False)))
        self.messages.append(message)

    def flags(self) -> list[Column]:
        return [F.col(f"{_CHECK}{i}") for i in range(len(self.messages))]


def _not_null(c: _Checked, rule: dict) -> None:
    name = c.column(rule)
    if name:
        c.add(is_blank(name, dtype_of(c.df, name)), f"Missing {name}")


def _compare(c: _Checked, rule: dict) -> None:
    one, two = c.column(rule, "col1"), c.column(rule, "col2")
    if one and two:
        a, b = (F.coalesce(as_number(c.df, n), F.lit(0)) for n in (one, two))
        c.add(F.abs(a - b) > F.lit(rule.get("tolerance") or 0), f"Mismatch {one} vs {two}")


def _number(c: _Checked, rule: dict) -> None:
    name = c.column(rule)
    if not name:
        return
    was = f"{_CHECK}present"
    number = as_ledger_number(c.df, name)
    c.df = c.df.withColumns({was: ~is_blank(name, dtype_of(c.df, name)), name: number})
    c.add(F.col(was) & col(name).isNull(), f"Invalid number in {name}")
    c.df = c.df.drop(was)
    if rule.get("min") is not None:
        c.add(col(name) < F.lit(rule["min"]), f"{name} < {rule['min']}")
    if rule.get("max") is not None:
        c.add(col(name) > F.lit(rule["max"]), f"{name} > {rule['max']}")


def _date(c: _Checked, rule: dict) -> None:
    name = c.column(rule)
    if not name:
        return
    dtype = dtype_of(c.df, name)
    text = col(name).cast("string")
    user_format = (rule.get("format") or "").removeprefix("format=")
    if is_time(dtype):
        parsed = col(name)
    elif user_format:
        parsed = parse_with_format(text, user_format)
    else:
        parsed = parse_date(text, day_first=rule.get("locale") != "US")
    was = f"{_CHECK}present"
    c.df = c.df.withColumns({was: ~is_blank(name, dtype), name: parsed})
    c.add(F.col(was) & col(name).isNull(), f"Invalid date format in {name}")
    c.df = c.df.drop(was)


def _unique(c: _Checked, rule: dict) -> None:
    """Flag every row of a repeated value; missing values count as equal.

    Repeated values are found by a grouped count and joined back, so a value that fills a large
    part of the table is split over tasks instead of landing in one window.
    """
    name = c.column(rule)
    if not name:
        return
    key = f"{_CHECK}key"
    hit = f"{_CHECK}hit"
    repeated = (
        c.df.groupBy(col(name).alias(key))
        .agg(F.count(F.lit(1)).alias(hit))
        .filter(F.col(hit) > 1)
    )
    c.df = c.df.join(repeated, col(name).eqNullSafe(F.col(key)), "left")
    c.add(F.col(hit).isNotNull(), f"Duplicate {name}")
    c.df = c.df.drop(key, hit)


def _regex(c: _Checked, rule: dict) -> None:
    name, pattern = c.column(rule), rule.get("pattern")
    if not name or not pattern:
        return
    anchored = f"^(?:{pattern})"
    try:
        c.df.sparkSession.sql("select '' rlike :p", {"p": anchored}).collect()
        matched = F.coalesce(col(name).cast("string").rlike(anchored), F.lit(False))
    except PySparkException as error:
        log.warning("invalid pattern %r: %s", pattern, error)
        matched = F.lit(False)
    c.add(~matched, f"Regex mismatch {name}")


def _enum(c: _Checked, rule: dict) -> None:
    name, values = c.column(rule), rule.get("values")
    if name and values:
        allowed = [str(v).strip().upper() for v in values]
        known = F.upper(col(name).cast("string")).isin(*allowed)
        c.add(~F.coalesce(known, F.lit(False)), f"Invalid enum {name}")


def _outliers(c: _Checked, rules: list[dict]) -> None:
    """A run of OUTLIER rules, measured together in one pass per method."""
    numbers = {n: as_number(c.df, n) for n in filter(None, map(c.column, rules))}
    zscore = {c.column(r) for r in rules if r.get("method") == "zscore"} - {None}
    fences = iqr_fences(
        c.df,
        {c.column(r): numbers[c.column(r)] for r in rules
         if r.get("method") != "zscore" and c.column(r)},
        K.OUTLIER_MIN_ROWS,
    )
    spread = {}
    if zscore:
        order = sorted(zscore)
        row = c.df.agg(*[
            m for i, n in enumerate(order) for m in (
                F.count(numbers[n]).alias(f"n{i}"),
                F.avg(numbers[n]).alias(f"mean{i}"),
                F.stddev_samp(numbers[n]).alias(f"std{i}"),
            )
        ]).first()
        spread = {
            n: (row[f"mean{i}"], row[f"std{i}"])
            for i, n in enumerate(order)
            if row[f"n{i}"] >= K.OUTLIER_MIN_ROWS and (row[f"std{i}"] or 0) > 0
        }
    for rule in rules:
        name = c.column(rule)
        if rule.get("method") == "zscore" and name in spread:
            mean, std = spread[name]
            limit = float(rule.get("threshold", K.ZSCORE_THRESHOLD))
            c.add(F.abs(numbers[name] - mean) / std > limit, f"Outlier {name}")
        elif rule.get("method") != "zscore" and name in fences:
            c.add(outside(numbers[name], fences[name]), f"Outlier {name}")


_CHECKS = {
    "NOT_NULL": _not_null,
    "COMPARE": _compare,
    "NUMBER": _number,
    "DATE": _date,
    "UNIQUE": _unique,
    "REGEX": _regex,
    "ENUM": _enum,
}


def _check(df: DataFrame, config: dict) -> _Checked:
    rules = parse_rules(option(config, "validationRules", "rules", default=[]))
    checked = _Checked(df)
    for kind, run in groupby(rules, key=lambda r: str(r.get("type", "")).upper()):
        if kind == "OUTLIER":
            _outliers(checked, list(run))
        elif kind in _CHECKS:
            for rule in run:
                _CHECKS[kind](checked, rule)
    return checked


def drops_rows(config: dict) -> bool:
    """Whether failing rows leave the flow. Financial data is only ever flagged."""
    return (
        config.get("validationMode", "flag") == "drop"
        and config.get("_source_category") != K.FLAG_ONLY_CATEGORY
    )


def validate(df: DataFrame, config: dict) -> DataFrame:
    """Flag mode adds the issues column; drop mode keeps the rows that pass."""
    if drops_rows(config):
        return split_valid(df, config)[0]
    checked = _check(df, config)
    texts = [F.when(f, F.lit(m)) for f, m in zip(checked.flags(), checked.messages, strict=True)]
    issues = F.concat_ws("; ", *texts) if texts else F.lit("")
    return checked.df.select(
        *[col(n) for n in df.columns if n != K.ISSUES],
        F.when(issues != "", issues).otherwise("PASS").alias(K.ISSUES),
    )


def split_valid(df: DataFrame, config: dict) -> tuple[DataFrame, DataFrame]:
    """The rows that pass all rules, and the rows that fail one."""
    checked = _check(df, config)
    failed = F.lit(False)
    for flag in checked.flags():
        failed = failed | flag
    names = [col(n) for n in df.columns]
    return checked.df.filter(~failed).select(*names), checked.df.filter(failed).select(*names)


def quarantine_record(rejected: DataFrame, count: int, reason: str, as_of: Column) -> DataFrame:
    """One row: the reason with the number of rejected rows, and a JSON sample of them."""
    return (
        rejected.limit(K.FAILED_ROWS_SAMPLE)
        .select(F.struct(*[col(n) for n in rejected.columns]).alias("row"))
        .agg(F.to_json(F.collect_list("row"), {"ignoreNullFields": "false"}).alias("failed_data"))
        .select(
            F.lit(f"{reason} ({count} rows)").alias("reason"),
            "failed_data",
            as_of.cast("timestamp").alias("created_at"),
        )
    )
