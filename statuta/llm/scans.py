"""Problem 4: text of scanned pages, with its damage found and repaired."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from statuta.runtime import cut, join_groups, kept

#: Pages of a file that one window task orders; the blocks of a file are linked by their edges.
PAGE_BLOCK = 256
#: Lines from a page's top among which running headers are looked for, as many as there are.
EDGE_LINES = 6
#: Forms that are sent to all tasks at most; more are joined by a shuffle.
BROADCAST_FORMS = 200_000
#: Glyphs read one for another. Each group comes down to its last member.
SINGLE_FROM, SINGLE_TO = "e†1i|50@9hß8äöü6¨", "ctlllsoagbbbaouo"
LIGATURES = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("ﬃ", "ffi"), ("ﬄ", "ffl"))
PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"), ("ll", "u"))
HYPHENS = "-‐­¬"
#: A word of letters alone counts as misread beside a form of the same skeleton that is so many times as frequent; less
#: will do where the word before it supports that form, and none where it holds glyphs that no word has.
RATIO, RATIO_IN_CONTEXT = 50, 4
NUMBER = "[0-9lIO|oSB]+"
NUMBER_LINE = rf"(?i)^(?:[-—–\[]|p\.|page|seite|s\.)?\s*({NUMBER})\s*(?:(?:/|of|von)\s*{NUMBER}\s*)?[-—–\]]?$"
EDGE_CHARS = ".,;:()“”„\"'’‘—–!?[]…«»·"
EDGE = f"[{re.escape(EDGE_CHARS)}]"
#: All white space of Unicode.
WHITE = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Letters that no skeleton changes; a line's own in their order tell most lines apart at little cost.
STEADY = "gjkpqstyz"


def skeleton(c: Column) -> Column:
    """A word with confusable glyphs made one, in lower case."""
    x = F.lower(c)
    for a, b in LIGATURES:
        x = F.replace(x, F.lit(a), F.lit(b))
    x = F.translate(x, SINGLE_FROM, SINGLE_TO)
    for a, b in PAIRS:
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def bare(c: Column) -> Column:
    """A word without the punctuation around it."""
    return F.btrim(c, F.lit(EDGE_CHARS))


def _trim(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def pages(raw: DataFrame) -> DataFrame:
    """One row per page with `ls`, its lines that aren't blank as (line_no, line), blank ones counted in line_no.

    A page extracted twice counts once, by its longest text; null and blank pages are left out.
    """
    best = F.max(F.struct(F.length("text"), F.col("text"))).alias("b")
    one = raw.where("source_file is not null and page_number is not null and text is not null").groupBy("source_file", "page_number").agg(best, F.max("parent_document").alias("parent_document"))
    each = F.transform(F.split("b.text", "\n"), lambda x, i: F.struct((i + 1).alias("line_no"), _trim(x).alias("line")))
    x = one.select("source_file", "page_number", "parent_document", F.filter(each, lambda x: x["line"] != "").alias("ls"))
    return x.where(F.size("ls") > 0)


def _tokens(line: Column) -> Column:
    """A trimmed line cut at white space; the pattern for all of Unicode is slower and seldom needed."""
    return F.when(F.octet_length(line) == F.length(line), F.split(line, r"\s+")).otherwise(F.split(line, r"(?U)\s+"))


def _masked(c: Column) -> Column:
    return F.regexp_replace(c, r"\b[0-9lIOo]*[0-9][0-9lIOo]*\b", "")


def _letters(c: Column) -> Column:
    return _trim(F.regexp_replace(c, r"[^\p{L}]+", " "))


def _kind(line: Column) -> Column:
    """A line without digits, roman numerals and marks, by its skeleton's hash: what headers of many files share."""
    return F.xxhash64(skeleton(_letters(F.regexp_replace(F.lower(_masked(line)), r"\b[ivxlc1]+\b", ""))))


PAGE = ["source_file", "page_number"]
LINE = [*PAGE, "line_no"]


def marks(pg: DataFrame) -> DataFrame:
    """(source_file, page_number, line_no, defect) of the page numbers and running headers.

    A line of a number only, near the page's edge, is a page number if it differs from page_number by what most such
    lines of its file do. The first other line of a page is a header if, with its digits masked, it comes at the top of
    other pages of the file, or of many files, rather than inside pages; below a header the next line is looked at
    alike, as far as there are headers within EDGE_LINES lines. The title that opens page 1 is no header.
    """
    n = F.size("ls")
    edge = F.filter(F.transform("ls", lambda x, i: F.struct(x["line_no"].alias("line_no"), x["line"].alias("line"), ((i <= 2) | (n - i <= 3)).alias("near"))), lambda x: x["near"])
    x = pg.select(*PAGE, F.explode(edge).alias("x")).select(*PAGE, "x.line_no", F.translate(F.regexp_extract("x.line", NUMBER_LINE, 1), "lIO|oSB", "1101058").alias("digits"))
    x = cut(x.where((F.col("digits") != "") & (F.length("digits") < 9)).withColumn("off", F.col("digits").cast("long") - F.col("page_number")))
    votes = x.groupBy("source_file", "off").agg(F.count(F.lit(1)).alias("v"))
    mode = votes.groupBy("source_file").agg(F.max(F.struct(F.col("v"), -F.abs(F.col("off")), F.col("off"))).alias("m")).select("source_file", F.col("m.off").alias("off"))
    found = cut(x.join(mode, ["source_file", "off"]).select(*LINE, F.lit("page_number").alias("defect")))
    out = found.groupBy(*PAGE).agg(F.collect_set("line_no").alias("out"))
    act = _letters(skeleton(F.regexp_replace(F.coalesce("parent_document", F.lit("")), "[0-9]+", "")))
    top = pg.select(*PAGE, act.alias("act"), F.slice("ls", 1, EDGE_LINES).alias("ms")).join(out, PAGE, "left")
    rest = cut(top.select(*PAGE, "act", F.filter("ms", lambda m: ~F.coalesce(F.array_contains("out", m["line_no"]), F.lit(False))).alias("ms")))
    while True:
        heads = cut(_heads(rest.where(F.size("ms") > 0), pg))
        if heads.isEmpty():
            return found
        found = found.unionByName(heads.withColumn("defect", F.lit("running_header")))
        # pages go on below their header
        rest = cut(rest.join(heads.select(*PAGE), PAGE, "left_semi").withColumn("ms", F.slice("ms", F.lit(2), F.size("ms"))))


def _steady(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), f"[^{STEADY}]+", "")


def _heads(rest: DataFrame, pg: DataFrame) -> DataFrame:
    """(source_file, page_number, line_no) of the pages' first lines that are headers."""
    mask = lambda c: _letters(skeleton(_masked(c)))
    first = rest.select(*PAGE, "act", F.col("ms")[0]["line_no"].alias("line_no"), F.col("ms")[0]["line"].alias("line"), F.get("ms", F.lit(1))["line"].alias("second"))
    first = cut(first.withColumns({"mask": mask(F.col("line")), "kind": _kind(F.col("line"))}).where("mask <> ''"))
    own = first.groupBy("source_file", "mask").agg(F.count(F.lit(1)).alias("own_pages"))
    kinds = first.groupBy("kind").agg(F.count(F.lit(1)).alias("tops"), F.sum((F.col("page_number") == 1).cast("int")).alias("opening"))
    kinds = kinds.join(first.select("kind", "source_file").distinct().groupBy("kind").agg(F.count(F.lit(1)).alias("files")), "kind")
    top = join_groups(first.join(own, ["source_file", "mask"]), cut(kinds), ["kind"], "tops", first.count())
    top = cut(top.where("own_pages >= 2 or files >= 3"))
    # lines of these kinds anywhere: few have the same steady letters, and only those are brought to their kind
    steady = top.select(_steady(F.col("line")).alias("steady")).distinct()
    anywhere = pg.where("page_number > 1").select(F.explode("ls.line").alias("line")).withColumn("steady", _steady(F.col("line"))).join(_small(steady), "steady", "left_semi")
    anywhere = anywhere.select(_kind(F.col("line")).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("others"))
    tops = cut(top.select("kind", "tops").distinct().join(anywhere, "kind", "left").withColumn("others", F.coalesce("others", F.lit(0))))
    top = join_groups(top.drop("tops"), tops, ["kind"], "tops", top.count()).withColumn("alls", F.col("others") + F.col("opening"))
    likely = ((F.col("own_pages") >= 2) & (F.col("tops") * 2 >= F.col("alls"))) | ((F.col("files") >= 3) & (F.col("tops") * 5 >= F.col("alls") * 4))
    # on page 1, a line that begins with the act's name is the title unless the next line begins with it too
    named = (F.col("act") != "") & F.col("mask").startswith(F.col("act")) & ~F.col("line").contains("|")
    title = (F.col("page_number") == 1) & named & ~F.coalesce(mask(F.col("second")).startswith(F.col("act")), F.lit(False))
    return top.where(likely & ~title).select(*LINE)


def body(pg: DataFrame, mk: DataFrame) -> DataFrame:
    """The body's lines, each with its whole words `ws` and with what it shares with the lines before and after it.

    `head` and `tail` are the parts of a word that the line's end and the next line's beginning may share, `last` and
    `after` the whole tokens they stand in, `soft` tells the hyphen that may belong to the word. `skip` tells a line
    whose first token ends such a word. `prev` is the token before the first of ws, null where a paragraph begins;
    `starts` tells a line behind a blank one, `breaks` one at a page's beginning behind the end of a sentence. Lines are
    cut into words here, once; pages are ordered by their first and last lines alone, within blocks of PAGE_BLOCK pages,
    and the blocks by theirs.
    """
    out = mk.groupBy(*PAGE).agg(F.collect_set("line_no").alias("out"))
    rid = lambda c: F.filter(c, lambda x: ~F.coalesce(F.array_contains("out", x["line_no"]), F.lit(False)))
    # marks stand in the first EDGE_LINES and the last 3 lines, so one of these is left, or none at all
    few = EDGE_LINES + 4
    ends = pg.select(*PAGE, F.slice("ls", 1, few).alias("a"), F.slice("ls", F.greatest(F.size("ls") - few + 1, F.lit(1)), F.lit(few)).alias("b")).join(out, PAGE, "left")
    ends = ends.select(*PAGE, "out", F.floor(F.col("page_number") / PAGE_BLOCK).alias("block"), F.get(rid("a"), F.lit(0))["line"].alias("first"), F.try_element_at(rid("b"), F.lit(-1))["line"].alias("last")).where("first is not null")
    ends = cut(ends)
    blocks = ends.groupBy("source_file", "block").agg(F.min_by("first", "page_number").alias("bf"), F.max_by("last", "page_number").alias("bl"))
    wb = W.partitionBy("source_file").orderBy("block")
    blocks = blocks.select("source_file", "block", F.lead("bf").over(wb).alias("bf"), F.lag("bl").over(wb).alias("bl"))
    w = W.partitionBy("source_file", "block").orderBy("page_number")
    ends = ends.select(*PAGE, "out", "block", F.lead("first").over(w).alias("pf"), F.lag("last").over(w).alias("pl")).join(blocks, ["source_file", "block"])
    ends = ends.select(*PAGE, "out", F.coalesce("pf", "bf").alias("page_next"), F.coalesce("pl", "bl").alias("page_before"))
    x = pg.drop("parent_document").join(ends, PAGE).withColumn("ls", rid("ls"))
    x = x.select(*PAGE, "page_next", "page_before", F.col("ls").alias("all"), F.posexplode("ls").alias("i", "x"))
    behind, before = F.get("all", F.col("i") + 1)["line"], F.when(F.col("i") > 0, F.get("all", F.col("i") - 1))
    x = x.select(
        *PAGE, "x.line_no", "x.line", F.when(F.col("i") + 1 < F.size("all"), behind).otherwise(F.col("page_next")).alias("next"), F.coalesce(before["line"], F.when(F.col("i") == 0, F.col("page_before"))).alias("before"),
        (F.col("i") == 0).alias("page_start"), F.coalesce(F.col("x.line_no") - before["line_no"] > 1, F.lit(False)).alias("starts"),
    )
    # a last glyph is looked at before any pattern is tried
    hyphened = lambda c: F.substring(c, -1, 1).isin(*HYPHENS)
    glyphs = r"[\p{L}\p{Nd}†@¨]"
    goes_on = r"^[\p{L}†@0-9ﬁﬂ]"
    head = F.when(hyphened(F.col("line")), F.regexp_extract("line", rf"(\S*{glyphs})[{HYPHENS}]+$", 1)).otherwise("")
    x = x.withColumn("head", head)
    x = x.withColumn("head", F.when((F.col("head") != "") & F.coalesce(F.col("next").rlike(goes_on), F.lit(False)), F.ltrim(F.col("head"), F.lit(EDGE_CHARS))))
    skip = F.when(F.coalesce(hyphened(F.col("before")), F.lit(False)), F.col("before").rlike(rf"{glyphs}[{HYPHENS}]+$") & F.col("line").rlike(goes_on)).otherwise(F.lit(False))
    x = x.withColumns({"skip": skip, "toks": _tokens(F.col("line"))})
    cut_off = F.col("head").isNotNull()
    after = F.when(cut_off, F.regexp_extract("next", r"^(\S+)", 1))
    lo = F.when(F.col("skip"), 2).otherwise(1)
    ws = F.slice("toks", lo, F.greatest(F.size("toks") - lo + 1 - cut_off.cast("int"), F.lit(0)))
    prev = F.when(F.col("skip"), F.col("toks")[0]).otherwise(F.when(~F.col("starts"), F.regexp_extract(F.coalesce("before", F.lit("")), r"^(?:.*\s)?(\S+)$", 1)))
    breaks = F.col("starts") | (F.col("page_start") & F.coalesce(F.col("before").rlike(r"[.!?:][”“»\"')]*$"), F.lit(True)))
    # a line that is one token only, ending one word and beginning the next, is neither
    alone = F.col("skip") & cut_off & (F.size("toks") == 1)
    x = x.select(
        *LINE, "head", F.when(cut_off, bare(after)).alias("tail"), F.when(cut_off & ~alone, F.element_at("toks", -1)).alias("last"), after.alias("after"),
        F.substring("line", -1, 1).isin("-", "‐").alias("soft"), "skip", "starts", breaks.alias("breaks"), prev.alias("prev"), ws.alias("ws"),
    )
    return kept(x)


ODD = r"[\p{L}][0-9†@|¨]|[0-9†@|¨][\p{L}]|[†@|]|[ﬁﬂﬀ]|\p{Ll}\p{Lu}"
STOPS = (".", "!", "?", ":", ")")


def tokens(b: DataFrame) -> DataFrame:
    """The body's whole words as they stand: raw, the token before it (null or '' for none), whether it begins a sentence."""
    x = b.select(*LINE, "prev", "ws", F.posexplode("ws").alias("i", "raw"))
    prev = F.when(F.col("i") > 0, F.get("ws", F.col("i") - 1)).otherwise(F.col("prev"))
    x = x.select(*LINE, "raw", prev.alias("prev"))
    ends = lambda *of: reduce(lambda p, q: p | q, [F.endswith("prev", F.lit(e)) for e in of])
    stop = ends(*STOPS) | (ends("”", "“", "»") & ends(*[f"{e}{q}" for e in STOPS for q in "”“»"]))
    return x.withColumn("begins", F.col("prev").isNull() | (F.col("prev") == "") | stop)


def cased(form: Column, first: Column, begins: Column, raw: Column, capital: Column) -> Column:
    """A form in the case its place asks for; `first` is the raw word's first glyph."""
    up = F.concat(F.upper(F.substring(form, 1, 1)), F.substring(form, F.lit(2), F.length(form)))
    same = F.lower(first) == F.substring(form, 1, 1)
    letters = F.regexp_replace(raw, r"[^\p{L}]", "")
    shout = (F.length(letters) >= 2) & (letters == F.upper(letters)) & (F.length(form) > 2)
    return (
        F.when(shout, F.upper(form))
        .when(same & first.rlike(r"^\p{Lu}"), up)
        .when(same, form)
        .when(first.rlike(r"^\p{Lu}") | begins | capital, up)
        .otherwise(form)
    )


def vocabulary(raws: DataFrame) -> DataFrame:
    """(skel, form, n, capital) of every form of the corpus, in lower case; odd ones hold glyphs that no word has."""
    odd = F.col("word").rlike(ODD)
    cap = F.col("word").rlike(r"^\p{Lu}\p{Ll}").cast("int")
    v = raws.groupBy("form").agg(F.sum("n").alias("n"), F.max(odd).alias("odd"), F.sum(F.col("inner") * cap).alias("c"), F.sum("inner").alias("i"))
    return v.select(skeleton(F.col("form")).alias("skel"), "form", "n", "odd", (F.col("c") * 2 > F.col("i")).alias("capital"))


def repairs(b: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(misread words with their right form, best form of each skeleton).

    Tokens are counted as they stand, and all patterns are tried on the different ones only; then the places of those in
    doubt are looked up.
    """
    ts = tokens(b)
    counts = ts.groupBy("raw", "begins").agg(F.count(F.lit(1)).alias("n"))
    raws = counts.groupBy("raw").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("begins"), 0).otherwise(F.col("n"))).alias("inner"))
    raws = cut(raws.withColumn("word", bare(F.col("raw"))).where(F.col("word").rlike(r"[\p{L}†@]")).withColumn("form", F.lower("word")))
    v = cut(vocabulary(raws))
    best = v.where("not odd").groupBy("skel").agg(F.max(F.struct("n", "form", "capital")).alias("b"))
    best = cut(best.select("skel", F.col("b.form").alias("best"), F.col("b.n").alias("best_n"), F.col("b.capital").alias("capital")))
    # forms that another of their skeleton may stand for; what isn't sure needs the words before it
    doubt = v.drop("capital").join(best, "skel").where("form <> best and (odd or best_n >= n * %d)" % RATIO_IN_CONTEXT)
    doubt = cut(doubt.withColumn("sure", F.col("odd") | (F.col("best_n") >= F.col("n") * RATIO)).drop("n", "odd", "best_n"))
    size = raws.agg(F.sum("n")).first()[0] or 0
    cand = cut(_places(ts, raws.join(doubt, "form"), size))
    right = cased(F.col("best"), F.substring("word", 1, 1), F.col("begins"), F.col("word"), F.col("capital"))
    show = lambda df: df.select(*LINE, "word", right.alias("repaired")).where("word <> repaired")
    found = show(cand.where("sure"))
    before = F.lower(bare(F.col("prev")))
    open_ = cand.where("not sure").withColumn("prev", before).where("prev <> ''")
    asked = cut(open_.groupBy("prev", "skel", "form", "best").agg(F.count(F.lit(1)).alias("places")))
    if asked.isEmpty():
        return found, best
    rivals = raws.join(v.join(asked.select("skel").distinct(), "skel", "left_semi").select("skel", "form"), "form").select("raw", "n", "skel", "form")
    near = _places(ts, rivals, size).withColumn("prev", before).groupBy("prev", "skel", "form").agg(F.count(F.lit(1)).alias("m"))
    near = near.join(asked.select("prev", "skel").distinct(), ["prev", "skel"], "left_semi")
    usual = near.groupBy("prev", "skel").agg(F.max(F.struct("m", "form")).alias("s")).where("s.m >= 2").select("prev", "skel", F.col("s.form").alias("best"))
    backed = cut(asked.join(usual, ["prev", "skel", "best"]).select("prev", "form", "places"))
    return found.unionByName(show(join_groups(open_, backed, ["prev", "form"], "places", open_.count()))), best


def _places(ts: DataFrame, raws: DataFrame, total: int) -> DataFrame:
    """The tokens among raws, which has its number of places as `n`: sent to all tasks if it is small, else joined."""
    raws = cut(raws)
    if raws.count() <= BROADCAST_FORMS:
        return ts.join(F.broadcast(raws), "raw")
    return join_groups(ts, raws, ["raw"], "n", total)


def _small(df: DataFrame) -> DataFrame:
    """df marked for broadcast if it has few enough rows, which is counted; else as it is, for a shuffle."""
    return F.broadcast(df) if df.count() <= BROADCAST_FORMS else df


def joined(b: DataFrame, best: DataFrame) -> DataFrame:
    """Words broken over a line's end: the parts put together as the corpus writes them, hyphenated or not.

    Parts that the corpus never joins, of which the second is a word of its own after a hyphen kept (pre- and
    post-market), are no broken word.
    """
    x = b.where("head is not null and tail is not null and tail <> ''")
    one, two = F.concat("head", "tail"), F.concat_ws("-", "head", "tail")
    side = lambda c, p: best.select(F.col("skel").alias(c), F.col("best").alias(f"{p}_form"), F.col("best_n").alias(f"{p}_n"), F.col("capital").alias(f"{p}_cap"))
    x = x.withColumn("s1", skeleton(one)).withColumn("s2", skeleton(two)).withColumn("s3", skeleton(F.col("tail")))
    x = x.join(side("s1", "a"), "s1", "left").join(side("s2", "b"), "s2", "left").join(side("s3", "c"), "s3", "left")
    hyphened = F.coalesce(F.col("b_n"), F.lit(0)) > F.coalesce(F.col("a_n"), F.lit(0))
    known = F.coalesce(F.col("a_n"), F.col("b_n")).isNotNull()
    apart = ~known & F.col("c_n").isNotNull() & F.col("soft") & (F.length("head") <= 6) & (F.lower("tail") == F.col("c_form"))
    form = F.when(hyphened, F.col("b_form")).when(F.col("a_n").isNotNull(), F.col("a_form"))
    cap = F.when(hyphened, F.col("b_cap")).otherwise(F.coalesce(F.col("a_cap"), F.lit(False)))
    repaired = F.coalesce(cased(form, F.substring("head", 1, 1), F.lit(False), F.concat("head", "tail"), cap), one)
    return x.where(~apart).select("source_file", "page_number", "line_no", "head", "tail", repaired.alias("repaired"))


def damage(raw: DataFrame) -> DataFrame:
    """(source_file, page_number, line_no, defect, repaired) of every damaged place."""
    pg = kept(pages(raw))
    mk = marks(pg)
    b = body(pg, mk)
    wrong, best = repairs(b)
    broken = joined(b, best)
    cols = ["source_file", "page_number", "line_no"]
    out = broken.select(*cols, F.lit("broken_word").alias("defect"), "repaired")
    out = out.unionByName(wrong.select(*cols, F.lit("wrong_characters").alias("defect"), "repaired"))
    return out.unionByName(mk.select(*cols, "defect", F.lit("").alias("repaired")))


def paragraphs(raw: DataFrame) -> DataFrame:
    """(source_file, paragraph, text): the repaired body reflowed, paragraphs numbered from 1 in reading order.

    A paragraph ends at a blank line, or at a page's end if its last line ends a sentence; it is one text, however many
    pages it runs over. A file of null or blank pages gives none.
    """
    pg = kept(pages(raw))
    b = body(pg, marks(pg))
    wrong, best = repairs(b)
    fix = wrong.groupBy(*LINE).agg(F.map_from_entries(F.array_distinct(F.collect_list(F.struct("word", "repaired")))).alias("fix"))
    whole = joined(b, best).select(*LINE, F.col("repaired").alias("whole"))
    x = b.join(fix, LINE, "left").join(whole, LINE, "left")

    def mend(t: Column) -> Column:
        w = bare(t)
        right = F.try_element_at(F.col("fix"), w)
        return F.when(right.isNotNull(), F.replace(t, w, right)).otherwise(t)

    # a line gives its first token to the line before it if both share a word, or may share one
    edge = lambda c, left: F.regexp_extract(c, rf"^({EDGE}*)" if left else rf"({EDGE}*)$", 1)
    joint = F.when(F.col("whole").isNotNull(), F.array(F.concat(edge(F.col("last"), True), F.col("whole"), edge(F.col("after"), False)))).otherwise(F.filter(F.array("last", "after"), lambda t: t.isNotNull()))
    text = F.concat(F.when(F.col("fix").isNull(), F.col("ws")).otherwise(F.transform("ws", mend)), joint)
    x = x.withColumn("block", F.floor(F.col("page_number") / PAGE_BLOCK)).withColumn("breaks", F.col("breaks").cast("int"))
    w = W.partitionBy("source_file", "block").orderBy("page_number")
    x = x.select("source_file", "page_number", "block", "line_no", F.array_join(text, " ").alias("line"), "breaks")
    per = x.groupBy("source_file", "block", "page_number").agg(F.sum("breaks").alias("n"))
    per_block = per.groupBy("source_file", "block").agg(F.sum("n").alias("n"))
    base = per_block.select("source_file", "block", F.coalesce(F.sum("n").over(W.partitionBy("source_file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    on_page = per.select("source_file", "block", "page_number", F.coalesce(F.sum("n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("page_base")).join(base, ["source_file", "block"])
    run = F.sum("breaks").over(W.partitionBy("source_file", "page_number").orderBy("line_no"))
    x = x.join(on_page.drop("block"), ["source_file", "page_number"]).withColumn("paragraph", F.col("base") + F.col("page_base") + run)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "line_no", "line"))), lambda t: t["line"]), " ")
    return x.groupBy("source_file", "paragraph").agg(_trim(F.regexp_replace(text, " +", " ")).alias("text"))
