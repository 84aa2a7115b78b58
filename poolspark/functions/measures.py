"""Parsing and labelling of measured values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
MISSING_TOKENS = (  # strings that a tabular reader treats as missing
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
NUMBER_PATTERN = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
MEASURE_PRIORITY = (("Ki", "ki"), ("Kd", "kd"), ("IC50", "ic50"))
GAS_CONSTANT_KCAL = 0.0019872041
DEFAULT_TEMPERATURE_K = 298.15
DEFAULT_THRESHOLD_NM = 1000.0


def missing_to_null_text(text: Column) -> Column:
    return F.when(~text.isin(*MISSING_TOKENS), text)


def parse_measure(text: Column) -> Column:
    """First number in a messy string ("<10", ">1,200", " 5. "); NULL when there is none.

    The ANSI-safe cast matters: an empty match must become NULL, not an error.
    """
    cleaned = F.regexp_replace(F.trim(text), ",", "")
    return F.regexp_extract(cleaned, NUMBER_PATTERN, 0).try_cast("double")


def relation_of(text: Column) -> Column:
    """The censoring sign that parsing drops: "<", ">" or "="."""
    sign = F.substring(F.trim(text), 1, 1)
    return F.when(sign.isin("<", ">"), sign).otherwise("=")


def best_measure(priority: Sequence[tuple[str, str]] = MEASURE_PRIORITY) -> Column:
    """Generator of measure_type, value, relation: the first positive measure, else NULLs.

    It is a generator on purpose. As a plain expression the parsing would be repeated in every
    filter that Catalyst pushes towards the scan; generator output is computed once.
    """
    candidates = F.array(
        *[
            F.struct(
                F.lit(kind).alias("measure_type"),
                parse_measure(F.col(column)).alias("value"),
                relation_of(F.col(column)).alias("relation"),
            )
            for kind, column in priority
        ]
    )
    # NaN sorts above every number in Spark, so it has to be refused by name.
    usable = F.filter(candidates, lambda m: (m["value"] > 0) & ~F.isnan(m["value"]))
    return F.inline_outer(F.slice(usable, 1, 1))


def free_energy(value_nm: Column, temperature: float = DEFAULT_TEMPERATURE_K) -> Column:
    """Delta G = R T ln(K) in kcal/mol, K given in nM."""
    return F.lit(GAS_CONSTANT_KCAL * temperature) * F.log(value_nm * F.lit(1e-9))


def activity_label(value_nm: Column, threshold_nm: Column | float = DEFAULT_THRESHOLD_NM) -> Column:
    """1 at or below the threshold, else 0."""
    limit = threshold_nm if isinstance(threshold_nm, Column) else F.lit(float(threshold_nm))
    return (value_nm <= limit).cast("int")


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))
