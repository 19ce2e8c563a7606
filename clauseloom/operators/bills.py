"""Itemised lines held against a list of names: parsing, token matching, totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions.text import n3

# Words that tell no item from another.
STOPWORDS = (
    "CHARGES CHARGE EXPENSES EXPENSE COST COSTS FEE FEES AND OR THE OF FOR PER IN ON TO A AN WITH ANY ALL ITEM ITEMS MISC OTHER OTHERS USED DURING IF NOT NO "
    "ROOM LONG SHORT SMALL LARGE MEDIUM EXTRA"
).split()
#: A name without a telling word matches as a whole, from this length on.
MIN_WHOLE = 8
AMOUNT = r"(?i)(?:(?:RS|INR|₹)\.?\s*)?(\d[\d,]*(?:\.\d{1,2})?)\s*$"


def tokens(text: Column | str) -> Column:
    return F.filter(F.regexp_extract_all(n3(text), F.lit("([A-Z]+)"), 1), lambda t: F.length(t) >= 2)


def distinctive(text: Column | str) -> Column:
    """Words that tell an item; repetitions stay."""
    return F.filter(tokens(text), lambda t: (F.length(t) >= 3) & ~t.isin(STOPWORDS))


def present(needle: Column, hay: Column) -> Column:
    """Whether a word is in a line, plural and the like allowed: one begins with the other, two letters apart at most."""
    return F.exists(hay, lambda t: (t == needle) | ((F.length(needle) >= 3) & (F.startswith(t, needle) | F.startswith(needle, t)) & (F.abs(F.length(t) - F.length(needle)) <= 2)))


def prepared_items(items: DataFrame, order: str) -> DataFrame:
    """(order, item columns..., alt_seq, alt, needed): an item's alternatives, split at slashes, with their telling words."""
    trimmed = F.transform(F.split("item_name", r"\s*/\s*"), lambda a: F.regexp_replace(a, r"^[ ,.;:-]+|[ ,.;:-]+$", ""))
    alts = items.select("*", F.posexplode(F.filter(trimmed, lambda a: a != "")).alias("alt_seq", "alt"))
    return alts.withColumn("needed", distinctive("alt"))


def bill_lines(bills: DataFrame, id: str, text: str) -> DataFrame:
    """(id, line_no, raw, description, amount): lines of three characters or more with a telling word; the amount at
    their end set aside, a serial number at their front dropped. An amount that cannot be read is null."""
    lines = bills.select(F.col(id).alias("bill"), F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]")).alias("i", "raw"))
    lines = lines.withColumn("raw", F.trim("raw")).where(F.length("raw") >= 3)
    amount = F.regexp_extract("raw", AMOUNT, 1)
    body = F.trim(F.regexp_replace(F.when(amount != "", F.regexp_replace("raw", AMOUNT, "")).otherwise(F.col("raw")), r"^\s*\d{1,3}[.):]\s+", ""))
    out = lines.select("bill", (F.col("i") + 1).alias("line_no"), "raw", F.regexp_replace(body, r"[\s.:;,|-]+$", "").alias("description"), F.expr("1").alias("_"), F.when(amount != "", F.regexp_replace(amount, ",", "").try_cast("double")).alias("amount"))
    return out.where(F.size(distinctive("description")) > 0).drop("_")


def matched_lines(lines: DataFrame, items: DataFrame, order: str) -> DataFrame:
    """lines with the best item, or null: all telling words of an alternative in the line, or, where it has none, the
    alternative as a whole; the longest words win, then the first item, then the first alternative.

    Lines are matched once per distinct description. An alternative meets descriptions by its longest telling word, as
    written and as far as plurals and the like go: a word of the line begins with it or it with the word, two letters
    apart at most. One without a telling word meets them by its first word; nothing is compared with all lines.
    """
    alts = prepared_items(items, order).withColumn("score", F.when(F.size("needed") > 0, F.aggregate("needed", F.lit(0), lambda s, t: s + F.length(t))).otherwise(F.length("alt")))
    texts = lines.select("description").distinct().withColumn("words", tokens("description"))
    # of two words that are alike, one is the other or begins it with at most two letters more: they share a front
    fronts = lambda t: F.array(t, F.left(t, F.length(t) - 1), F.left(t, F.length(t) - 2))
    near = lambda t: F.filter(F.array_distinct(fronts(t)), lambda k: F.length(k) >= 2)
    keyed = texts.withColumn("k", F.explode(F.array_distinct(F.flatten(F.transform("words", near)))))
    telling = F.array_max(F.transform("needed", lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]
    by_word = alts.where(F.size("needed") > 0).withColumn("k", F.explode(near(telling)))
    hits = keyed.join(by_word, "k").where(F.forall("needed", lambda n: present(n, F.col("words")))).drop("k")
    first = lambda x: F.regexp_extract(n3(x), "([A-Z]{2,})", 1)
    whole = alts.where((F.size("needed") == 0) & (F.length("alt") >= MIN_WHOLE)).withColumn("k", first("alt"))
    # a name inside a line may begin within a word of it, so its first word meets the line's runs of letters by their ends
    ends = F.flatten(F.transform(F.regexp_extract_all(n3("description"), F.lit("([A-Z]+)"), 1), lambda t: F.transform(F.sequence(F.lit(1), F.length(t)), lambda i: F.substring(t, i, F.length(t)))))
    fits = (F.col("k") == "") | F.exists("_ends", lambda e: F.startswith(e, F.col("k")))
    inside = texts.withColumn("_ends", ends).withColumn("_b", F.explode(F.array_distinct(F.concat(F.array(F.lit("")), F.transform(F.filter("_ends", lambda e: F.length(e) >= 2), lambda e: F.left(e, F.lit(2)))))))
    met = inside.join(whole.withColumn("_b", F.left("k", F.lit(2))), "_b").where(fits & F.contains(n3("description"), n3("alt"))).drop("_ends", "_b", "k")
    hits = hits.unionByName(met)
    best = hits.groupBy("description").agg(F.max_by(F.struct(F.col(order).alias("item"), "item_name", F.col("alt").alias("matched_alternative"), "category", "category_description"), F.struct("score", (-F.col(order)).alias("o"), (-F.col("alt_seq")).alias("a"))).alias("m"))
    return lines.join(best, "description", "left").select(*lines.columns, "m.*")


def findings(matched: DataFrame) -> DataFrame:
    """The flagged lines with their rank in their bill: what is never payable first, then by amount, the largest first, an
    unknown one as 0, then in order of the lines."""
    w = Window.partitionBy("bill").orderBy(F.col("category") != "not_payable", F.desc(F.coalesce("amount", F.lit(0.0))), "line_no")
    return matched.where("item is not null").withColumn("rank", F.row_number().over(w))


def by_charge(matched: DataFrame) -> DataFrame:
    """Per bill and category of flagged lines: lines, known sum, and the share of the bill that is never payable or charged
    twice, as a group: never for what is never payable, twice for what another charge includes."""
    found = matched.where("item is not null").withColumn("group", F.when(F.col("category") == "not_payable", "never").otherwise("twice"))
    return found.groupBy("bill", "group", "category").agg(F.count("*").alias("lines"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"))


def by_category(matched: DataFrame) -> DataFrame:
    """Per category of matched lines: lines, their sum (null amounts left out), whether all amounts are known."""
    found = matched.where("item is not null")
    return found.groupBy("category").agg(F.count("*").alias("lines"), F.coalesce(F.sum("amount"), F.lit(0.0)).alias("amount"), F.every(F.col("amount").isNotNull()).alias("amount_known"))


def totals(matched: DataFrame) -> DataFrame:
    """Per bill: lines read and flagged, sums, flagged lines without amount, flagged share (null where the total is 0)."""
    flagged = F.col("item").isNotNull()
    t = matched.groupBy("bill").agg(
        F.count("*").alias("lines_read"), F.count_if(flagged).alias("lines_flagged"), F.count_if(flagged & F.col("amount").isNull()).alias("without_amount"),
        F.round(F.coalesce(F.sum("amount"), F.lit(0.0)), 2).alias("bill_total"), F.round(F.coalesce(F.sum(F.when(flagged, F.col("amount"))), F.lit(0.0)), 2).alias("flagged_total"),
    )
    return t.withColumn("flagged_share", F.round(F.try_divide("flagged_total", F.nullif("bill_total", F.lit(0.0))), 4))


def letter(matched: DataFrame) -> DataFrame:
    """(bill, letter): the flagged lines of a bill as text in two sections with their sums."""
    line = F.format_string("%d. %s: %s", "line_no", "description", F.coalesce(F.format_number("amount", 2), F.lit("amount not stated")))
    first = F.col("category") == "not_payable"
    rows = matched.where("item is not null").groupBy("bill").agg(
        F.array_sort(F.collect_list(F.when(first, F.struct("line_no", line.alias("l"))))).alias("a"), F.array_sort(F.collect_list(F.when(~first, F.struct("line_no", line.alias("l"))))).alias("b"),
        F.coalesce(F.sum(F.when(first, F.col("amount"))), F.lit(0.0)).alias("sa"), F.coalesce(F.sum(F.when(~first, F.col("amount"))), F.lit(0.0)).alias("sb"),
    )
    part = lambda head, x, s: F.when(F.size(x) > 0, F.concat(F.lit(head + "\n"), F.array_join(F.transform(x, lambda r: r["l"]), "\n"), F.lit("\nTotal: "), F.format_number(s, 2)))
    return rows.select("bill", F.concat_ws("\n\n", part("A. Never payable", "a", "sa"), part("B. Part of another charge", "b", "sb"), F.concat(F.lit("Sum: "), F.format_number(F.col("sa") + F.col("sb"), 2))).alias("letter"))
