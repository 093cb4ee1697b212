"""Labelled structural units from the lines of journal pages.

Acceptance of headers is decided by folds over the few candidate lines of a document; everything else is set-based:
regions by the positions of markers, the state in force by counting, units by grouping.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.functions.refs import cross_references, roman, section_kind
from statuta.functions.text import strip

# The layout of the journal.
ARTICLE, PAREN, ANNEX = r"^Article (\d+)$", r"^\((\d+)\)$", r"^ANNEX ([IVXLC]+)$"
DEFINITION = r"^\((\d+)\)(?:\s+\S.*)?$"
HEADING = r"^(CHAPTER [IVXLC]+|SECTION \d+)$"
OPEN_ENDING = r"\b(with|to|in|of|and|for|under|by|on)$"
WHEREAS = "Whereas:"
ENACTING = r"^HAVE ADOPTED THIS (REGULATION|DIRECTIVE|DECISION):$"
SIGNATURE = r"^Done at .+, \d{1,2} \w+ \d{4}\.$"
DEFINITIONS_ARTICLE = 3
ELI = r"^ELI: http://data\.europa\.eu/eli/\S+$"
FURNITURE = r"^(EN|Official Journal|of the European Union|L series|OJ L, \d{1,2}\.\d{1,2}\.\d{4}|\d{4}/\d+|\d{1,2}\.\d{1,2}\.\d{4}|\d+/\d+|ELI: http://data\.europa\.eu/eli/\S+)$"


def lines(pages: DataFrame, doc: str = "source_file") -> DataFrame:
    """(doc, pos, line): the stripped lines in order without blanks and page furniture, pos counted over the document.

    Of a page with an ELI line, what stands from the furniture before the first one on is cut. The furniture is found
    inside the page's row, so only pages are ordered.
    """
    ls = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: strip(x))
    x = pages.select(doc, "page_number", ls.alias("ls")).withColumn("eli", F.array_position(F.transform("ls", lambda t: t.rlike(ELI)), True))
    # the last line before the ELI line that is neither blank nor furniture
    keep = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("eli").cast("int") - 1, F.lit(1))), F.lit(0), lambda acc, i: F.when((F.get("ls", i - 1) == "") | F.get("ls", i - 1).rlike(FURNITURE), acc).otherwise(i))
    n = F.when(F.col("eli") == 0, F.size("ls")).when(F.col("eli") == 1, 0).otherwise(keep)
    x = x.withColumn("ls", F.filter(F.slice("ls", F.lit(1), n), lambda t: t != ""))
    # a line's number goes on from the lines of the pages before it
    before = F.coalesce(F.sum(F.size("ls")).over(W.partitionBy(doc).orderBy("page_number").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    at = x.select(doc, "page_number", before.alias("before"))
    x = x.join(at, [doc, "page_number"]).select(doc, "before", F.posexplode("ls").alias("i", "line"))
    return x.select(doc, (F.col("before") + F.col("i")).alias("pos"), "line")


def _accept(cands: Column, first_any: Column) -> Column:
    """Positions of candidates (n, pos) in order whose n is one more than that of the last accepted one.

    The first must be 1, or at least 1 if first_any.
    """
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<bigint>").alias("ok"))

    def step(s: Column, c: Column) -> Column:
        good = (c["n"] == s["last"] + 1) | (first_any & (s["last"] == 0) & (c["n"] >= 1))
        return F.when(good, F.struct(c["n"].alias("last"), F.concat(s["ok"], F.array(c["pos"])).alias("ok"))).otherwise(s)

    return F.aggregate(cands, start, step)["ok"]


def _found(x: DataFrame, doc: str, cond: Column, number: Column, name: str) -> DataFrame:
    """(doc, name): the positions of accepted headers among the lines that meet cond."""
    c = x.where(cond).groupBy(doc, "strict").agg(F.array_sort(F.collect_list(F.struct("pos", number.cast("int").alias("n")))).alias("c"))
    c = c.withColumn("c", F.transform("c", lambda t: F.struct(t["n"].alias("n"), t["pos"].alias("pos"))))
    return c.select(doc, F.explode(_accept(F.col("c"), ~F.col("strict"))).alias("pos")).withColumn(name, F.lit(True))


def units(pages: DataFrame, doc: str = "source_file", source_url: str = "", publication_date: str = "") -> DataFrame:
    """The units of each document: article_number, section_type, title, text, chunk_index, cross_references.

    A document with a region marker is read strictly: recitals between `Whereas:` and the enacting line, articles up to
    the signature, annexes behind it. Others are read leniently: any header anywhere, and numbers may begin above 1.
    Lines behind a chapter heading belong to nothing until the next article. Article 3 gives way to its definitions if
    it has any. Empty documents give no units.
    """
    x = lines(pages, doc)
    mark = F.when(F.col("line") == WHEREAS, "w").when(F.col("line").rlike(ENACTING), "e").when(F.col("line").rlike(SIGNATURE), "s")
    m = x.withColumn("m", mark).groupBy(doc).agg(
        F.min(F.when(F.col("m") == "w", F.col("pos"))).alias("w0"), F.min(F.when(F.col("m") == "e", F.col("pos"))).alias("e0"),
        F.array_sort(F.collect_list(F.when(F.col("m") == "s", F.col("pos")))).alias("ss"), F.coalesce(F.bool_or(F.col("m").isin("w", "e")), F.lit(False)).alias("strict"),
    )
    far = F.lit((1 << 62) - 1)
    m = m.withColumn("e", F.coalesce("e0", far)).withColumn("w", F.when(F.col("w0") < F.col("e"), F.col("w0")))
    m = m.withColumn("s", F.coalesce(F.get(F.filter("ss", lambda p: p > F.col("e")), F.lit(0)), far)).select(doc, "strict", "w", "e", "s")
    x = x.join(m, doc)
    lenient = ~F.col("strict")
    in_recitals = lenient | (F.col("w").isNotNull() & (F.col("pos") > F.col("w")) & (F.col("pos") < F.col("e")))
    in_articles = lenient | ((F.col("pos") > F.col("e")) & (F.col("pos") < F.col("s")))
    in_annexes = lenient | (F.col("pos") > F.col("s"))
    marker = F.col("strict") & ((F.col("pos") == F.col("e")) | (F.col("pos") == F.col("s")) | (F.col("pos") == F.coalesce("w", F.lit(-1))))
    x = x.withColumn("marker", marker)
    num = lambda p: F.regexp_extract("line", p, 1)
    nxt = F.lead("line").over(W.partitionBy(doc).orderBy("pos"))
    x = x.withColumn("next", nxt)
    arts = _found(x, doc, in_articles & F.col("line").rlike(ARTICLE), num(ARTICLE), "art")
    anns = _found(x, doc, in_annexes & F.col("line").rlike(ANNEX), roman(num(ANNEX)), "ann")
    x = x.join(arts, [doc, "pos"], "left").join(anns, [doc, "pos"], "left")
    heading = F.col("line").rlike(HEADING) & in_articles
    # the last article, annex, heading or end of the articles before a line decides whether it is among definitions
    event = F.when(F.col("art"), num(ARTICLE).cast("int")).when(F.col("ann") | heading | (F.col("marker") & (F.col("pos") != F.coalesce("w", F.lit(-1)))), -1)
    back = W.partitionBy(doc).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    x = x.withColumn("heading", heading & F.col("art").isNull()).withColumn("event", event).withColumn("inside", F.last("event", ignorenulls=True).over(back) == DEFINITIONS_ARTICLE)
    x = x.withColumn("inside", F.coalesce("inside", F.lit(False)))
    rec = _found(x, doc, in_recitals & ~F.col("inside") & F.col("line").rlike(PAREN) & F.coalesce(F.col("next").rlike(r"^[\p{Lu}‘'\"]"), F.lit(False)), num(PAREN), "rec")
    dfn = _found(x, doc, F.col("inside") & F.col("line").rlike(DEFINITION), num(DEFINITION), "dfn")
    x = x.join(rec, [doc, "pos"], "left").join(dfn, [doc, "pos"], "left")
    label = (
        F.when(F.col("art"), F.concat(F.lit("Article "), num(ARTICLE)))
        .when(F.col("ann"), F.concat(F.lit("Annex "), num(ANNEX)))
        .when(F.col("rec"), F.concat(F.lit("Recital "), num(PAREN)))
        .when(F.col("dfn"), F.concat(F.lit(f"Article {DEFINITIONS_ARTICLE}("), num(DEFINITION), F.lit(")")))
    )
    x = x.withColumn("label", label)
    # a unit begins at each header; what comes before the first is the preamble
    x = x.withColumn("unit", F.sum(F.when(F.col("label").isNotNull() | (F.col("marker") & (F.col("pos") != F.coalesce("w", F.lit(-1)))) | F.col("heading"), 1).otherwise(0)).over(back))
    # behind a heading or the enacting line nothing counts until an article
    enacting = F.col("strict") & (F.col("pos") == F.col("e"))
    off = F.last(F.when(F.col("heading") | enacting, True).when(F.col("art"), False), ignorenulls=True).over(back)
    x = x.withColumn("off", F.coalesce(off, F.lit(False)))
    # nor between a marker and the next header
    closed = F.last(F.when(F.col("label").isNotNull() | (F.col("pos") == F.coalesce("w", F.lit(-1))), False).when(F.col("marker"), True), ignorenulls=True).over(back)
    x = x.withColumn("closed", F.coalesce(closed, F.lit(False)))
    x = x.withColumn("lost", F.coalesce(F.col("strict") & (F.col("pos") > F.col("w")) & (F.col("unit") == 0), F.lit(False))).where(~F.col("lost"))
    x = x.where((~F.col("off") | F.col("label").isNotNull()) & ~F.col("heading") & ~(F.col("closed") & F.col("label").isNull()))
    g = x.groupBy(doc, "unit").agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("ls"), F.max("label").alias("label"), F.min("pos").alias("pos"), F.bool_or(F.coalesce("dfn", F.lit(False))).alias("is_dfn"), F.first("strict").alias("strict"))
    body = F.transform(F.slice("ls", F.when(F.col("label").isNotNull(), 2).otherwise(1), F.size("ls")), lambda t: t["line"])
    title0 = F.struct(F.get("body", F.lit(0)).alias("t"), F.lit(True).alias("open"))

    def more(s: Column, line: Column) -> Column:
        go = s["open"] & (line.rlike(r"^\p{Ll}") | s["t"].rlike(OPEN_ENDING))
        return F.when(go, F.struct(F.concat_ws(" ", s["t"], line).alias("t"), F.lit(True).alias("open"))).otherwise(F.struct(s["t"].alias("t"), F.lit(False).alias("open")))

    g = g.withColumn("body", body)
    titled = F.col("label").startswith("Article ") & ~F.col("is_dfn") | F.col("label").startswith("Annex ")
    title = F.when(titled & (F.size("body") > 0), F.aggregate(F.slice("body", F.lit(2), F.size("body")), title0, more)["t"]).otherwise("")
    g = g.withColumn("title", F.coalesce(title, F.lit(""))).withColumn("label", F.coalesce("label", F.when(F.col("strict") | (F.col("unit") == 0), F.lit("Preamble"))))
    g = g.where((F.col("label") != "Preamble") | F.col("strict"))
    text = strip(F.array_join(F.transform("ls", lambda t: t["line"]), "\n"))
    g = g.withColumn("text", text).where(F.col("text") != "")
    # the article of definitions gives each its heading and leaves its place to them
    bare = f"Article {DEFINITIONS_ARTICLE}"
    heads = g.where(F.col("label") == bare).groupBy(doc).agg(F.max("title").alias("d_title"))
    has = g.where("is_dfn").select(doc).distinct().withColumn("has", F.lit(True))
    g = g.join(heads, doc, "left").join(has, doc, "left")
    g = g.where(~(F.coalesce("has", F.lit(False)) & (F.col("label") == bare)))
    g = g.withColumn("text", F.when(F.col("is_dfn"), F.concat_ws("\n", F.lit(bare), F.when(F.col("d_title") != "", F.col("d_title")), F.col("text"))).otherwise(F.col("text")))
    g = g.withColumn("title", F.when(F.col("is_dfn"), F.coalesce("d_title", F.lit(""))).when(F.col("label") == "Preamble", "Preamble").otherwise(F.col("title")))
    kind = (
        F.when(F.col("is_dfn"), "definition").when(F.col("label").startswith("Recital"), "recital").when(F.col("label").startswith("Annex"), "annex")
        .when(F.col("label").startswith("Article"), section_kind(F.col("title"))).otherwise("general")
    )
    index = F.row_number().over(W.partitionBy(doc).orderBy("pos")) - 1
    return g.select(F.col("label").alias("article_number"), kind.alias("section_type"), "title", "text", index.alias("chunk_index"), F.col(doc).alias("parent_document"), F.lit(source_url).alias("source_url"), F.lit(publication_date).alias("publication_date"), cross_references(F.col("text")).alias("cross_references"))


def kinds(us: DataFrame, label: str = "article_number", doc: str = "parent_document") -> DataFrame:
    """(doc, kind, number, value) of labelled units; definitions count by their own number."""
    part = lambda p, n=1: F.regexp_extract(label, p, n)
    kind = F.when(F.col(label).rlike(r"^Article \d+\(\d+\)"), "definition").otherwise(F.lower(part(r"^(Article|Annex|Recital) ")))
    number = F.when(F.col("kind") == "definition", part(r"\((\d+)\)")).otherwise(part(r"^\w+ (\d+|[IVXLC]+)"))
    x = us.withColumn("kind", kind).where(F.col("kind") != "").withColumn("number", number).where(F.col("number") != "")
    return x.select(doc, "kind", "number", F.when(F.col("kind") == "annex", roman(F.col("number"))).otherwise(F.col("number").try_cast("int")).alias("value"))


def structure(us: DataFrame, label: str = "article_number", doc: str = "parent_document") -> DataFrame:
    """(doc, kind, numbers): the sorted numbers of each kind."""
    return kinds(us, label, doc).groupBy(doc, "kind").agg(F.array_sort(F.collect_set("value")).alias("numbers"))


def gaps(us: DataFrame, label: str = "article_number", doc: str = "parent_document") -> DataFrame:
    """(doc, kind, number) of numbers from 1 to the greatest that no unit has."""
    s = structure(us, label, doc)
    return s.select(doc, "kind", F.explode(F.array_except(F.sequence(F.lit(1), F.array_max("numbers")), "numbers")).alias("number"))


def duplicates(us: DataFrame, label: str = "article_number", doc: str = "parent_document") -> DataFrame:
    return us.where(F.col(label).isNotNull()).groupBy(doc, label).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
