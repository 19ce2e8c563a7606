"""Units of recorded columns, solved from identities among columns.

A recorded value and the quantities of its row are tied by an identity: recorded * unit = one of the
stated amounts. Of the units a column may have, the one with the least mean log residual over all
rows is its unit; where another one is about as good, the solution is flagged as not unique.
"""

from __future__ import annotations

import re

import pyarrow as pa
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clauseloom.functions.quantities import DAYS, DURATION_UNITS, MONEY_SCALES, PERCENT, RUPEES, Spellings, quantities
from clauseloom.session import cut_lineage

#: A residual beyond this is as bad as any other: rows whose record is wrong must not outweigh the rest.
CLIP = 3.0
#: Two units whose mean residuals differ by less are no unique solution.
MARGIN = 0.05

# What the parts of a column's name say about it.
_KIND_PARTS = {"wait": DAYS, "waiting": DAYS, "period": DAYS, "monetary": RUPEES, "inr": RUPEES, "rs": RUPEES, "amount": RUPEES, "percent": PERCENT, "pct": PERCENT, "fraction": PERCENT, "bps": PERCENT, "share": PERCENT, "ratio": PERCENT}
_SHARE_PARTS = {"percent": 1.0, "pct": 1.0, "bps": 0.01, "fraction": 100.0, "ratio": 100.0}
#: The units a column of each kind may have where its name is silent.
OPEN_UNITS = {DAYS: [1 / 24, 1, 7, 30, 365], RUPEES: [0.01, 1, 1e3, 1e5, 1e7], PERCENT: [0.01, 1, 100]}


def name_units(name: str) -> tuple[str, list[float]] | None:
    """(kind, candidate units) of a column by its name, in any of the usual styles; None if it names no quantity."""
    parts = [p.lower() for p in re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+", name)]
    scale = next((MONEY_SCALES[p] for p in parts if p in MONEY_SCALES and len(p) > 1), None)
    span = next((DURATION_UNITS[p] for p in parts if p in DURATION_UNITS and len(p) > 1), None)
    share = next((_SHARE_PARTS[p] for p in parts if p in _SHARE_PARTS), None)
    if share is not None:
        return PERCENT, [share]
    if span is not None:
        return DAYS, [span]
    if scale is not None:
        return RUPEES, [scale]
    kind = next((_KIND_PARTS[p] for p in parts if p in _KIND_PARTS and p != "period"), None)
    return (kind, OPEN_UNITS[kind]) if kind and kind != DAYS or kind == DAYS and "basis" not in parts else None


def stated(df: DataFrame, id: str, text: str) -> DataFrame:
    """(id, kind, amount): every quantity in text, distinct per row, in common units."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = Spellings()
        for batch in batches:
            ids, kinds, amounts = [], [], []
            for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for kind, amount in sorted(quantities(t, spell)):
                    ids.append(i), kinds.append(kind), amounts.append(amount)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(kinds, pa.string()), pa.array(amounts, pa.int64())], ["id", "kind", "amount"])

    return df.select(F.col(id).alias("id"), text).mapInArrow(read, "id long, kind string, amount long")


def solved_units(recorded: DataFrame, amounts: DataFrame, units: DataFrame) -> DataFrame:
    """(name, kind, unit, residual, unique) for each column name.

    recorded has (id, name, value), amounts (id, kind, amount), units (name, kind, unit): the candidates.
    For every row with an amount of the column's kind the residual of a unit is the least
    |ln(value * unit) - ln(amount)|, clipped at CLIP; rows without one say nothing. Zero and negative
    values and amounts have no logarithm and say nothing either. A name that no row speaks for keeps
    its first candidate and is flagged unless it has only one.
    """
    held = recorded.where("value > 0").join(F.broadcast(units), "name")  # candidates come from the fixed list of names
    held = held.join(amounts.where("amount > 0").groupBy("id", "kind").agg(F.collect_set("amount").alias("amounts")), ["id", "kind"])
    residual = F.array_min(F.transform("amounts", lambda a: F.abs(F.log(F.col("value") * F.col("unit")) - F.log(a))))
    fit = held.withColumn("r", F.least(residual, F.lit(CLIP))).groupBy("name", "kind", "unit").agg(F.avg("r").alias("residual"), F.count("*").alias("rows"))
    ranked = units.join(fit, ["name", "kind", "unit"], "left").groupBy("name", "kind").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("residual", F.lit(CLIP)).alias("r"), F.col("order"), "unit"))).alias("u"))
    second = F.when(F.size("u") > 1, F.col("u")[1]["r"]).otherwise(F.lit(float("inf")))
    return ranked.select("name", "kind", F.col("u")[0]["unit"].alias("unit"), F.col("u")[0]["r"].alias("residual"), (second - F.col("u")[0]["r"] > MARGIN).alias("unique"))


#: Combinations of units of one identity at most.
MOST_COMBINATIONS = 2000


def solved_combinations(df: DataFrame, exponents: dict[str, float], candidates: dict[str, list[float]]) -> DataFrame:
    """(units, residual, rows, unique): the units of several columns that an identity among them leaves, best first.

    exponents says the identity: the product of column ** exponent is one (mass / (density * volume):
    mass 1, density -1, volume -1). candidates has the units each column may be in; a column with one is known.
    The residual of a combination is the mean |log of the product| over the rows where all columns are
    positive, each clipped at CLIP; it is a sum of logarithms and the combination's own offset, so one pass
    over the rows serves all of them. units maps columns to units. unique is false for all combinations
    within MARGIN of the best where there is more than one: the identity cannot tell them apart. Without a
    row that speaks, residual is null and none is unique. More than MOST_COMBINATIONS are an error.
    """
    import itertools
    import math

    columns = sorted(exponents)
    combinations = list(itertools.product(*(candidates[c] for c in columns)))
    if len(combinations) > MOST_COMBINATIONS:
        raise ValueError(f"{len(combinations)} combinations of units, at most {MOST_COMBINATIONS}")
    good = df.where(" and ".join(f"coalesce(`{c}` > 0, false)" for c in columns))
    total = sum((F.lit(float(exponents[c])) * F.log(F.col(f"`{c}`").cast("double")) for c in columns), F.lit(0.0))
    offsets = [sum(exponents[c] * math.log(u) for c, u in zip(columns, combo)) for combo in combinations]
    distinct = sorted({round(o, 12) for o in offsets})  # many combinations move the product by the same
    means = good.select(total.alias("s")).agg(F.count("*").alias("n"), *[F.avg(F.least(F.abs(F.col("s") + o), F.lit(CLIP))).alias(f"m{i}") for i, o in enumerate(distinct)]).first()
    residual = {o: means[f"m{i}"] for i, o in enumerate(distinct)}
    scored = [(dict(zip(columns, combo)), residual[round(o, 12)]) for combo, o in zip(combinations, offsets)]
    least = min((r for _, r in scored if r is not None), default=None)
    near = sum(r is not None and r <= least + MARGIN for _, r in scored)
    rows = [({k: float(v) for k, v in u.items()}, r, means["n"], r is not None and r <= least + MARGIN and near == 1) for u, r in scored]
    rows.sort(key=lambda x: (x[1] is None, x[1] or 0.0, sorted(x[0].items())))
    return df.sparkSession.createDataFrame(rows, "units map<string,double>, residual double, rows long, unique boolean")


def candidate_units(names: DataFrame, name: str, open_: bool = False) -> DataFrame:
    """(name, kind, unit, order) of the distinct column names that name a quantity; with open_ all units of its kind,
    whatever the name says."""
    spark = names.sparkSession
    rows = [(n, found[0], float(u), k) for (n,) in names.select(name).distinct().collect() if (found := name_units(n)) for k, u in enumerate(OPEN_UNITS[found[0]] if open_ else found[1])]  # column names of a schema: a fixed list
    return spark.createDataFrame(rows, "name string, kind string, unit double, order int")


def common_units(df: DataFrame, id: str, text: str, fields: str, names: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """((id, origin, kind, amount), units): all quantities of df in common units, stated in text or recorded in the map
    fields (name -> struct with model), and the solved unit of each name. A name that says its unit leaves no choice; units
    also has free_unit, the one that the rows alone speak for among all of its kind, with its residual and whether it is
    unique, to hold against what the name says. Null records are none."""
    amounts = cut_lineage(stated(df, id, text))
    recorded = df.select(F.col(id).alias("id"), F.explode(F.transform_values(fields, lambda k, v: v["model"])).alias("name", "value")).where("value is not null and not isnan(value)")
    units = cut_lineage(solved_units(recorded, amounts, candidate_units(names, name)))
    values = recorded.join(F.broadcast(units), "name")  # one row a name
    values = values.select("id", F.lit("recorded").alias("origin"), "kind", F.floor(F.col("value") * F.col("unit") + 0.5 + 1e-9).cast("long").alias("amount"))
    return amounts.select("id", F.lit("text").alias("origin"), "kind", "amount").unionAll(values).distinct(), _beside(units, recorded, amounts, names, name)


def _beside(units: DataFrame, recorded: DataFrame, amounts: DataFrame, names: DataFrame, name: str) -> DataFrame:
    free = solved_units(recorded, amounts, candidate_units(names, name, open_=True))
    return units.join(F.broadcast(free.select("name", F.col("unit").alias("free_unit"), F.col("residual").alias("free_residual"), F.col("unique").alias("free_unique"))), "name")  # one row a name
