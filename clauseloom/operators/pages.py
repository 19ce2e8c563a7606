"""Pages: repeated furniture, folio offsets, sections, chunks, boundaries, coverage, reference lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clauseloom.functions.text import n6, n7
from clauseloom.session import cut_lineage, if_small

# Lines that are furniture whatever the document.
FURNITURE = [
    r"^\s*UIN\s*:", r"^\s*POLICY\s+WORDINGS?\s*$", r"^\s*\d+\s*/\s*\d+\s*$", r"^\s*Page\s+\d+\s+of\s+\d+\s*$", r"Registered\s+Office", r"Corporate\s+Office",
    r"Toll\s*free", r"^\s*CIN\s*[:.]", r"IRDA[I]?\s+Reg", r"^\s*Email\s*:.*Website\s*:", r"www\.[a-z]+\.com\s*$", r"INSURANCE\s+COMPANY\s+LIMITED", r"POL\s*/\s*\w+\s*/\s*V\.",
]
# Headings and the section they open.
SECTIONS = [
    (r"\bPREAMBLE\b", "preamble"), (r"\bOPERATIVE\s+CLAUSE\b", "operative"), (r"\bSTANDARD\s+DEFINITIONS\b", "definition"), (r"\bSPECIFIC\s+DEFINITIONS\b", "definition"),
    (r"\bDEFINITIONS\b", "definition"), (r"\bCOVERAGE\b", "coverage"), (r"\bBENEFITS?\s+COVERED\b", "coverage"), (r"\bSTANDARD\s+EXCLUSIONS\b", "exclusion"),
    (r"\bSPECIFIC\s+EXCLUSIONS\b", "exclusion"), (r"\bEXCLUSIONS\b", "exclusion"), (r"\bWAITING\s+PERIODS?\b", "waiting_period"), (r"\bSTANDARD\s+CONDITIONS\b", "condition"),
    (r"\bSPECIFIC\s+CONDITIONS\b", "condition"), (r"\bGENERAL\s+CONDITIONS\b", "condition"), (r"\bCONDITIONS\b", "condition"), (r"\bTABLE\s+OF\s+BENEFITS\b", "benefits_table"),
    (r"\bANNEXURE\s*[-–]?\s*A\b", "annexure"), (r"\bLIST\s+OF\s+INSURANCE\s+OMBUDSMAN\b", "ombudsman"), (r"\bGRIEVANCE\s+REDRESSAL\b", "ombudsman"),
]
MAX_LINE = 250


def page_lines(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, pos, line): the lines of every page, blank ones left out."""
    lines = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), F.posexplode(F.split(text, r"\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "")


def learned_furniture(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc, key, pages): keys of lines that stand on at least max(2, share of the pages) of their document's pages.
    Counts are partial where the rows are; a document's pages are never collected."""
    keyed = lines.withColumn("key", n6("line")).where((F.col("key") != "") & (F.length("line") <= MAX_LINE)).withColumn("_h", F.xxhash64("key"))
    total = lines.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("n"))
    # hashes are counted; the keys are fetched for those that are often enough
    on = keyed.select("doc", "_h", "page").distinct().groupBy("doc", "_h").agg(F.count("*").alias("pages"))
    often = on.join(total, "doc").where(F.col("pages") >= F.greatest(F.lit(2.0), share * F.col("n"))).select("doc", "_h", "pages")
    return keyed.select("doc", "_h", "key").join(if_small(often), ["doc", "_h"]).groupBy("doc", "key").agg(F.max("pages").alias("pages"))


def folio_offsets(lines: DataFrame, share: float = 0.3) -> DataFrame:
    """(doc, off, agreeing): the most frequent difference of a bare number line and its page, if max(3, share of the
    pages) agree; of equally frequent ones that which comes first."""
    bare = lines.where(F.col("line").rlike(r"^\s*\d{1,4}\s*$")).withColumn("off", F.trim("line").cast("long") - F.col("page"))
    counted = bare.groupBy("doc", "off").agg(F.count("*").alias("agreeing"), F.min(F.struct("page", "pos")).alias("first"))
    total = lines.select("doc", "page").distinct().groupBy("doc").agg(F.count("*").alias("n"))
    best = counted.groupBy("doc").agg(F.min_by(F.struct("off", "agreeing"), F.struct((-F.col("agreeing")).alias("a"), "first")).alias("b"))
    return best.join(total, "doc").where(F.col("b.agreeing") >= F.greatest(F.lit(3.0), share * F.col("n"))).select("doc", "b.off", "b.agreeing")


def edge_keys(lines: DataFrame, n: int = 2) -> DataFrame:
    """(doc, page, key): the keys of the first and last n lines of every page, blank ones aside, each once."""
    on_page = Window.partitionBy("doc", "page")
    outer = F.least(F.dense_rank().over(on_page.orderBy("pos")), F.dense_rank().over(on_page.orderBy(F.desc("pos")))) <= n
    return lines.withColumn("_outer", outer).where("_outer").select("doc", "page", n6("line").alias("key")).where("key <> ''").distinct()


def stripped(lines: DataFrame, furniture: DataFrame, offsets: DataFrame) -> DataFrame:
    """The lines that are wording: no learned furniture, folio, piece of learned furniture or furniture by pattern. Pieces
    agree in 22 letters if their key is among the first or last two lines of the page, in 44 elsewhere."""
    on_page = Window.partitionBy("doc", "page")
    outer = F.least(F.dense_rank().over(on_page.orderBy("pos")), F.dense_rank().over(on_page.orderBy(F.desc("pos")))) <= 2
    keyed = lines.repartition("doc", "page").withColumn("key", n6("line")).withColumn("_outer", outer).withColumn("_edge", F.max("_outer").over(Window.partitionBy("doc", "page", "key")))
    known = furniture.groupBy("doc").agg(F.collect_set("key").alias("_known"))  # on a tenth of the pages or more each: as many as a few pages have lines
    kept = keyed.join(if_small(offsets.select("doc", "off").join(known, "doc", "full")), "doc", "left")
    folio = F.col("line").rlike(r"^\s*\d{1,4}\s*$") & (F.trim("line").cast("long") - F.col("page") == F.col("off"))
    piece = fuzzy_furniture(F.col("line"), F.col("_known"), F.when(F.col("_edge"), 22).otherwise(44), F.col("key"))
    pattern = F.lit(False)
    for p in FURNITURE:
        pattern = pattern | F.col("line").rlike("(?i)" + p)
    return kept.where(~F.coalesce(folio, F.lit(False)) & ~F.coalesce(piece, F.lit(False)) & ~pattern).drop("key", "off", "_outer", "_edge", "_known")


def fuzzy_furniture(line: Column, known: Column, least: Column | int = 22, key: Column | None = None) -> Column:
    """Whether a line is a piece of known furniture: its key is one, or of 25 letters and inside one, or agrees with one
    at the front in `least` letters and three fifths of the shorter. key is that of the line, if there is such a column."""
    key = n6(line) if key is None else key
    floor = min(least, 25) if isinstance(least, int) else 22

    def close(k: Column) -> Column:
        shorter = F.least(F.length(key), F.length(k))
        need = F.greatest(F.lit(least) if isinstance(least, int) else least, F.ceil(0.6 * shorter).cast("int"))
        return (shorter >= need) & (F.left(key, need) == F.left(k, need)) & (F.length(key) <= F.length(k) + 32)

    # equal keys are looked up; only lines that may be pieces are compared
    return (F.length(line) <= MAX_LINE) & (key != "") & (F.array_contains(known, key) | ((F.length(key) >= floor) & F.exists(known, lambda k: ((F.length(key) >= 25) & F.contains(k, key)) | close(k))))


def section_label(text: str) -> Column:
    """The section a page opens: by what it is full of, else by its first heading; null if it says nothing."""
    t = F.coalesce(text, F.lit(""))
    n = lambda p: F.size(F.regexp_extract_all(t, F.lit(f"({p})"), 1))
    head = F.filter(F.split(t, r"\n"), lambda x: (F.length(F.trim(x)) > 0) & (F.length(x) <= 90))

    def heading(x: Column) -> Column:
        out = F.lit(None).cast("string")
        for p, label in reversed(SECTIONS):
            m = F.regexp_extract(x, f"(?i)({p})", 1)
            out = F.when((m != "") & ((F.length(m) > 0.35 * F.length(F.trim(x))) | (x == F.upper(x))), label).otherwise(out)
        return out

    first = F.get(F.filter(F.transform(head, heading), lambda x: x.isNotNull()), F.lit(0))
    return F.when(n(r"(?i)\bExcl\s*\.?\s*-?\s*\d{1,2}\b") >= 2, "exclusion").when(n(r"(?i)\bmeans\b") >= 3, "definition").when(n(r"(?i)\bwaiting\s+period\b") >= 2, "waiting_period").otherwise(first)


def sections(pages: DataFrame, doc: str, page: str, text: str) -> DataFrame:
    """(doc, page, section): every page with its section, carried forward from the last page that opened one."""
    w = Window.partitionBy("doc").orderBy("page")
    labelled = pages.select(F.col(doc).alias("doc"), F.col(page).alias("page"), section_label(text).alias("label"))
    return labelled.select("doc", "page", F.coalesce(F.last("label", ignorenulls=True).over(w), F.lit("unknown")).alias("section"))


def sentence_start_distance(text: Column) -> Column:
    """Characters from the last beginning of a sentence to the end; the whole length if there is none."""
    return F.length(F.regexp_replace(text, r"(?s)^.*[.!?]\s", ""))


def page_mark(page: Column) -> Column:
    return F.format_string("[[page %d]]", page)


def carried(text: Column, overlap: int) -> Column:
    """What of a page the next chunk opens with: all of it, or its last `overlap` characters from the beginning of a line
    on, if one begins within the first 200 of these."""
    tail = F.right(text, F.lit(overlap))
    line = F.locate("\n", F.left(tail, F.lit(200)))
    return F.when(F.length(text) <= overlap, text).when(line > 0, F.substring(tail, line + 1, F.lit(overlap))).otherwise(tail)


def chunk_borders(pages: DataFrame, most: int = 6000, overlap: int = 1500) -> DataFrame:
    """(doc, page, chunk, opens): the chunk of every page of pages (doc, page, section, text), and for the first page of one
    that was opened by length, the page whose end it carries.

    A chunk ends where the section changes, or where what it holds, page marks included, and the next page are longer
    than most; a page is never split. Blank pages are in none. Only lengths travel: pages go to a task by document and
    stream through it in order, sorted with spill, with one number for each; no document is held.
    """
    import pyarrow as pa

    def number(batches):  # noqa: ANN001, ANN202
        doc, section, chunk, held, last = None, None, -1, 0, (0, 0)
        for batch in batches:
            out = []
            for d, page, name, size, tail, mark in zip(*(batch.column(i).to_pylist() for i in range(6))):
                opens = None
                if d != doc:
                    doc, section, chunk, held = d, name, 0, 0
                elif name != section or held + size > most:
                    chunk += 1
                    if name == section and overlap:
                        opens = last[0]
                        held = last[1]
                    else:
                        held = 0
                    section = name
                held, last = held + size + mark, (page, tail + mark)
                out.append((d, page, chunk, opens))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.record_batch([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int64())], ["doc", "page", "chunk", "opens"])

    sized = _written(pages).select("doc", "page", "section", F.length("text").alias("size"), F.length(carried(F.col("text"), overlap)).alias("tail"), (F.length(page_mark(F.col("page"))) + 1).alias("mark"))
    return sized.repartition("doc").sortWithinPartitions("doc", "page").mapInArrow(number, "doc string, page long, chunk int, opens long")


def _written(pages: DataFrame) -> DataFrame:
    return pages.select(F.col("doc").cast("string").alias("doc"), F.col("page").cast("long").alias("page"), "section", "text").where(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", "") != "")


def chunks(pages: DataFrame, most: int = 6000, overlap: int = 1500) -> DataFrame:
    """(doc, chunk, section, text, start_page, end_page) of pages (doc, page, section, text): chunk_borders, and the text
    gathered afterwards; a chunk opened by length begins with the end of the page before. A null section is one of its
    own. Chunks are at most `most` characters and a page long."""
    written, borders = _written(pages), cut_lineage(chunk_borders(pages, most, overlap))
    whole = borders.join(written, ["doc", "page"]).select("doc", "chunk", "section", F.lit(1).alias("k"), "page", "text")
    ends = borders.where("opens is not null").select("doc", "chunk", F.col("opens").alias("page")).join(written, ["doc", "page"]).select("doc", "chunk", "section", F.lit(0).alias("k"), "page", carried(F.col("text"), overlap).alias("text"))
    pieces = whole.unionAll(ends).withColumn("text", F.concat_ws("\n", page_mark(F.col("page")), "text"))
    held = pieces.groupBy("doc", "chunk").agg(F.max_by("section", "page").alias("section"), F.array_sort(F.collect_list(F.struct("k", "page", "text"))).alias("x"))
    text = F.regexp_replace(F.array_join(F.transform("x", lambda p: p["text"]), "\n"), r"^\s+|\s+$", "")
    return held.select("doc", "chunk", "section", text.alias("text"), F.col("x")[0]["page"].alias("start_page"), F.element_at("x", -1)["page"].alias("end_page"))


def boundary_report(pages: DataFrame, most: int = 6000, overlap: int = 1500) -> DataFrame:
    """Per document of pages (doc, page, section, text): chunks without overlap, boundaries between two of one section, how
    many of these cut a sentence, how many of them the overlap recovers, and the others: (after_page, chars_back, tail)."""
    w = Window.partitionBy("doc").orderBy("chunk")
    b = chunks(pages, most, 0).withColumn("next", F.lead("section").over(w)).withColumn("within", F.coalesce(F.col("next") == F.col("section"), F.lit(False)))
    body = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\[\[page \d+\]\]", ""), r"[ \t]+", " "), r"^\s+|\s+$", "")
    b = b.withColumn("body", body).withColumn("cut", F.col("within") & (F.col("body") != "") & ~F.col("body").rlike(r"[.!?]$")).withColumn("back", sentence_start_distance(F.col("body")))
    lost = F.when(F.col("cut") & (F.col("back") > overlap), F.struct(F.col("end_page").alias("after_page"), F.col("back").alias("chars_back"), F.right("body", F.lit(70)).alias("tail")))
    return b.groupBy("doc").agg(F.count("*").alias("chunks"), F.count_if("within").alias("boundaries"), F.count_if("cut").alias("cut"), F.count_if(F.col("cut") & (F.col("back") <= overlap)).alias("recoverable"), F.array_sort(F.collect_list(lost)).alias("unrecovered"))


def silent_runs(sent: DataFrame, held: DataFrame) -> DataFrame:
    """(doc, first, last, pages): runs of pages that were sent (doc, page) but yielded nothing (held: doc, page)."""
    silent = sent.select("doc", "page").distinct().join(held.select("doc", "page").distinct(), ["doc", "page"], "left_anti")
    w = Window.partitionBy("doc").orderBy("page")
    return silent.withColumn("island", F.col("page") - F.row_number().over(w)).groupBy("doc", "island").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count("*").alias("pages")).drop("island")


def coverage_kinds(runs: DataFrame, ceiling: int = 8, warn: int = 3) -> DataFrame:
    """The runs with their level: block beyond the ceiling, warn from `warn` pages on, note else."""
    return runs.withColumn("level", F.when(F.col("pages") > ceiling, "block").when(F.col("pages") >= warn, "warn").otherwise("note"))


# Headings of the reference lists, their codes and what these say.
LISTS = {"I": "not_payable", "II": "subsume_room", "III": "subsume_procedure", "IV": "subsume_treatment"}
LIST_MEANINGS = {
    "not_payable": "Items for which coverage is not available in the policy", "subsume_room": "Items that are to be subsumed into Room Charges",
    "subsume_procedure": "Items that are to be subsumed into Procedure Charges", "subsume_treatment": "Items that are to be subsumed into costs of treatment",
}


def rejoined(lines: DataFrame) -> DataFrame:
    """lines (doc, page, pos, line) where a line that is a serial number alone stands before the next line of its page, if
    that begins with no number; columns are kept."""
    w = Window.partitionBy("doc", "page").orderBy("pos")
    lone = F.col("line").rlike(r"^\s*\d{1,3}[.):]?\s*$")
    marked = lines.withColumn("_lone", lone).withColumn("_before", F.lag(F.when(lone, F.trim("line"))).over(w)).withColumn("_after", F.lead("line").over(w))
    takes = F.col("_before").isNotNull() & ~F.col("_lone") & ~F.col("line").rlike(r"^\s*\d")
    given = F.col("_lone") & F.coalesce(~F.col("_after").rlike(r"^\s*\d"), F.lit(False))
    return marked.where(~given).withColumn("line", F.when(takes, F.concat_ws(" ", "_before", F.trim("line"))).otherwise(F.col("line"))).drop("_lone", "_before", "_after")


def list_items(lines: DataFrame) -> DataFrame:
    """(doc, page, pos, category, category_description, item): numbered items under `LIST I` to `LIST IV`, the list carried over lines and
    pages, up to the first page that names an ombudsman; header cells and short names dropped, the first of equal names kept."""
    w = Window.partitionBy("doc").orderBy("page", "pos")
    number = F.regexp_extract("line", r"(?i)\bLIST\s+(IV|I{1,3})\b", 1)
    labelled = rejoined(lines).withColumn("_l", F.when(number != "", F.upper(number))).withColumn("list", F.last("_l", ignorenulls=True).over(w))
    stopped = labelled.withColumn("_stop", F.max(F.when(F.col("line").rlike("(?i)OMBUDSMAN") & F.col("list").isNotNull(), 1).otherwise(0)).over(w)).where("_stop = 0 and list is not null and _l is null")
    items = stopped.select("doc", "page", "pos", "list", F.posexplode(F.regexp_extract_all("line", F.lit(r"(?:^|\s)\d{1,3}[.):]?\s+([A-Za-z][^\d\n]{2,70}?)(?=\s+\d{1,3}[.):]?\s+[A-Za-z]|\s*$)"), 1)).alias("k", "item"))
    category = F.create_map(*[F.lit(x) for kv in LISTS.items() for x in kv])[F.col("list")]
    good = items.withColumn("item", n7("item")).withColumn("category", category).where((F.length("item") >= 3) & ~F.upper("item").isin("ITEM", "ITEMS", "SL NO", "SL.NO", "S NO", "SR NO", "NO", "PARTICULARS"))
    first = good.groupBy("doc", "category", F.upper("item").alias("_u")).agg(F.min_by(F.struct("page", "pos", "k", "item"), F.struct("page", "pos", "k")).alias("x"))
    meaning = F.create_map(*[F.lit(x) for kv in LIST_MEANINGS.items() for x in kv])[F.col("category")]
    return first.select("doc", "x.page", "x.pos", "category", meaning.alias("category_description"), "x.item")


def gutter(words: DataFrame) -> DataFrame:
    """(doc, page, gutter): where a page of word boxes (doc, page, x0, x1, top, bottom, width, height) is split in two
    columns: the widest run of empty two-point buckets near the middle, eight points or more, ten words on each side."""
    body = words.where((F.col("top") > 0.15 * F.col("height")) & (F.col("bottom") < 0.85 * F.col("height")) & (F.col("x1") - F.col("x0") <= F.col("width") / 3))
    enough = body.groupBy("doc", "page").agg(F.count("*").alias("n"), F.max("width").alias("width")).where("n >= 15")
    taken = body.select("doc", "page", F.explode(F.sequence(F.floor(F.col("x0") / 2).cast("int"), F.floor(F.col("x1") / 2).cast("int"))).alias("b")).distinct()
    span = enough.select("doc", "page", "n", F.explode(F.sequence(F.floor(F.col("width") * 0.34 / 2).cast("int"), F.floor(F.col("width") * 0.66 / 2).cast("int"))).alias("b"))
    empty = span.join(taken, ["doc", "page", "b"], "left_anti").withColumn("i", F.col("b") - F.row_number().over(Window.partitionBy("doc", "page").orderBy("b")))
    runs = empty.groupBy("doc", "page", "i").agg(F.min("b").alias("a"), F.max("b").alias("z")).where("(z - a + 1) * 2 >= 8")
    best = runs.groupBy("doc", "page").agg(F.max_by(F.struct("a", "z"), F.struct(F.expr("z - a"), -F.col("a"))).alias("r")).select("doc", "page", F.expr("double(r.a + r.z + 1)").alias("gutter"))
    sides = body.join(best, ["doc", "page"]).groupBy("doc", "page", "gutter").agg(F.count_if(F.col("x1") <= F.col("gutter")).alias("l"), F.count_if(F.col("x0") >= F.col("gutter")).alias("r"))
    return sides.where("l >= 10 and r >= 10").select("doc", "page", "gutter")
