"""Column expressions: every one is a built-in Spark expression, so they stay
inside whole-stage codegen and fold to constants where their inputs are literal.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowrisk import schema as S


def col(c: str | Column) -> Column:
    """Column by name; names with spaces or slashes need no backticks this way."""
    if isinstance(c, Column):
        return c
    return F.col("`" + c.replace("`", "``") + "`")


def source_ip_from_port(port: str | Column, positive_mod: bool = False) -> Column:
    """Synthetic source address ``10.0.<port % 250 + 1>.1``.

    A null port gives a null address. With ``positive_mod`` a negative port maps
    into 1..250 instead of giving e.g. ``10.0.-2.1``.
    """
    p = col(port)
    bucket = F.pmod(p, F.lit(250)) if positive_mod else p % F.lit(250)
    return F.concat(F.lit("10.0."), (bucket + F.lit(1)).cast("string"), F.lit(".1"))


# Constant lookup tables are written as SQL literals: one expression parse in
# the JVM instead of one gateway call per literal, which keeps plan building
# (paid again for every micro-batch) cheap. The expressions are identical.


def sql_str(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def sql_name(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _sql_double(x: float) -> str:
    return f"{float(x)!r}D"


def map_sql(m: Mapping[object, object]) -> str:
    """``map(k1, v1, ...)`` literal text for string/number keys and values."""
    def lit(v):
        return sql_str(v) if isinstance(v, str) else (_sql_double(v) if isinstance(v, float) else str(int(v)))

    return "map(" + ", ".join(f"{lit(k)}, {lit(v)}" for k, v in m.items()) + ")"


def _severity_sql(attack_sql: str, table: Mapping[str, int]) -> str:
    return f"coalesce(try_element_at({map_sql(table)}, {attack_sql}), {S.DEFAULT_SEVERITY})"


def severity(attack: str | Column, table: Mapping[str, int] = S.SEVERITY_BY_ATTACK) -> Column:
    """Severity weight of an attack type, default 50 (one lookup in a literal map)."""
    if isinstance(attack, str):
        return F.expr(_severity_sql(sql_name(attack), table))
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(m, attack), F.lit(S.DEFAULT_SEVERITY))


def risk_score(confidence: str | Column, attack: str | Column) -> Column:
    """``round(min(100, conf*100*0.6 + severity*0.4), 2)``; a null confidence counts as 0."""
    if isinstance(confidence, str) and isinstance(attack, str):
        conf = f"coalesce(cast({sql_name(confidence)} AS double), 0.0D)"
        sev = f"cast({_severity_sql(sql_name(attack), S.SEVERITY_BY_ATTACK)} AS double)"
        raw = (f"{conf} * 100.0D * {_sql_double(S.CONFIDENCE_WEIGHT)} + {sev} * {_sql_double(S.SEVERITY_WEIGHT)}")
        return F.expr(f"round(least({_sql_double(S.RISK_CAP)}, {raw}), 2)")
    conf_c = F.coalesce(col(confidence).cast("double"), F.lit(0.0))
    raw_c = conf_c * F.lit(100.0) * F.lit(S.CONFIDENCE_WEIGHT) + severity(attack) * F.lit(S.SEVERITY_WEIGHT)
    return F.round(F.least(F.lit(S.RISK_CAP), raw_c), 2)


def decode_label(index: str | Column, labels: Sequence[str], unknown: str = S.UNKNOWN_ATTACK) -> Column:
    """Class index (double or int) -> label name; out-of-range, fractional or null -> ``unknown``.

    One lookup in a literal ``index -> label`` map, so the index expression is
    referenced once (it is inlined wherever the label is used downstream).
    """
    table = {float(i): x for i, x in enumerate(labels)}
    if isinstance(index, str):
        return F.expr(f"coalesce(try_element_at({map_sql(table)}, cast({sql_name(index)} AS double)), {sql_str(unknown)})")
    m = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in table.items()))
    return F.coalesce(F.try_element_at(m, index.cast("double")), F.lit(unknown))


def max_probability(probability: str | Column, digits: int = 6) -> Column:
    """Confidence = largest class probability of an ML ``probability`` vector."""
    from pyspark.ml.functions import vector_to_array

    return F.round(F.array_max(vector_to_array(col(probability))), digits)


def max_margin_probability(margins: str | Column, digits: int = 6) -> Column:
    """Confidence of one-vs-rest boosted trees: each class's margin m as the binary
    model's probability 1 / (1 + exp(-2m)), the largest as a share of their sum."""
    from pyspark.ml.functions import vector_to_array

    p = F.transform(vector_to_array(col(margins)), lambda m: 1.0 / (1.0 + F.exp(-2.0 * m)))
    return F.round(F.array_max(p) / F.aggregate(p, F.lit(0.0), lambda a, x: a + x), digits)


def max_of_array(values: str | Column, digits: int = 6) -> Column:
    return F.round(F.array_max(col(values)), digits)


def severity_band(risk: str | Column) -> Column:
    r = col(risk)
    return (
        F.when(r > 90, F.lit("critical"))
        .when(r > 80, F.lit("high"))
        .when(r > 50, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def normalize_confidence(conf: str | Column) -> Column:
    """Scale guard: a confidence above 1 is a percentage."""
    c = col(conf).cast("double")
    return F.when(c > 1, c / F.lit(100.0)).otherwise(c)


def confidence_band(conf: str | Column) -> Column:
    c = normalize_confidence(conf)
    return (
        F.when(c.isNull(), F.lit(None).cast("string"))
        .when(c >= 0.9, F.lit("high"))
        .when(c >= 0.7, F.lit("medium"))
        .otherwise(F.lit("low"))
    )


def confidence_percent(conf: str | Column) -> Column:
    return F.round(normalize_confidence(conf) * F.lit(100.0), 1)


def epoch_key_time(
    key: str | Column, prefix: str = S.ALERT_KEY_PREFIX, fallback: Column | None = None
) -> Column:
    """Alert key ``<prefix><epoch>`` -> timestamp; seconds or milliseconds by magnitude.

    A key whose suffix is not an integer, or lies outside the years 1 to 9999,
    gets ``fallback`` (the caller's ``as_of``).
    """
    k = col(key)
    suffix = F.when(k.startswith(prefix), F.substring(k, len(prefix) + 1, 1 << 20)).otherwise(k)
    n = suffix.try_cast("bigint")
    # seconds of the years 1 and 9999; a key beyond would overflow the conversion
    n = F.when((n >= S.EPOCH_SECONDS_RANGE[0]) & (n <= S.EPOCH_SECONDS_RANGE[1] * 1000), n)
    ts = F.when(n > S.EPOCH_MS_THRESHOLD, F.timestamp_millis(n)).otherwise(F.timestamp_seconds(n))
    return ts if fallback is None else F.coalesce(ts, fallback)


def age_seconds(ts: str | Column, as_of: Column) -> Column:
    return F.timestamp_diff("SECOND", col(ts), as_of)


def hour_minute(ts: str | Column) -> Column:
    return F.date_format(col(ts), "HH:mm")


def sorted_counts_text(m: str | Column) -> Column:
    """Canonical text of a counter map: ``k1=v1,k2=v2`` sorted by key."""
    entries = F.array_sort(F.map_entries(col(m)))
    return F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")


def counts_as_entries(m: str | Column, key_name: str = "attack_type", value_name: str = "count") -> Column:
    """A ``{name: count}`` map as a list of ``{key_name, value_name}`` structs (the
    legacy dictionary form of a breakdown turned into its list form)."""
    return F.transform(F.map_entries(col(m)), lambda e: F.struct(e["key"].alias(key_name), e["value"].alias(value_name)))
