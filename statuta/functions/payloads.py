"""Prompts, and JSON that a model wrote."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta.functions.text import strip


def source_label(label: Column, title: Column) -> Column:
    """`Source: L — title`; a chunk without label is unlabelled, one without title has none."""
    head = F.concat(F.lit("Source: "), F.when(label.isNotNull() & (label != ""), label).otherwise("(unlabelled)"))
    return F.concat(head, F.when(title.isNotNull() & (title != ""), F.concat(F.lit(" — "), title)).otherwise(""))


#: The frame of a question's prompt.
CONTEXT_HEADER = "Numbered passages follow, the best first. Answer from nothing else.\n\n<passages>\n"
CONTEXT_END = "</passages>\n\nAsked: "
ANSWER = "\n\nReply, naming the provisions it rests on:"


def prompts(hits: DataFrame, qkey: str = "query_id", query: str = "query") -> DataFrame:
    """(query, prompt): the passages of each query in rank order as numbered blocks, then the question."""
    block = F.concat(F.lit("["), (F.col("rank") + 1).cast("string"), F.lit("] "), source_label(F.col("article_number"), F.col("title")), F.lit("\n"), strip(F.col("text")), F.lit("\n"))
    g = hits.select(qkey, query, "rank", block.alias("b")).groupBy(qkey).agg(F.first(query).alias(query), F.array_sort(F.collect_list(F.struct("rank", "b"))).alias("bs"))
    body = F.array_join(F.transform("bs", lambda x: x["b"]), "\n")
    return g.select(qkey, F.concat(F.lit(CONTEXT_HEADER), body, F.lit(CONTEXT_END), F.col(query), F.lit(ANSWER)).alias("prompt"))


def numbered_blocks(texts: Column, first: int = 1, chars: int | None = None) -> Column:
    """An array of texts as numbered blocks, each cut to `chars`."""
    return F.array_join(F.transform(texts, lambda t, i: F.concat(F.lit("["), (i + first).cast("string"), F.lit("] "), F.substring(t, 1, chars) if chars else t)), "\n\n")


def system_prompt(version: Column, known: dict[str, str], default: str = "v1") -> Column:
    m = F.create_map(*[x for k, v in known.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(m, version), F.lit(known[default]))


def judgement(raw: Column, schema: str = "score DOUBLE, reasoning STRING, covered ARRAY<BOOLEAN>") -> Column:
    """The judge's object: the whole text, else from its first to its last brace; score 0 if neither is JSON."""
    strict = {"mode": "PERMISSIVE"}
    a = F.from_json(raw, schema, strict)
    b = F.from_json(F.regexp_extract(raw, r"(?s)\{.*\}", 0), schema, strict)
    return F.coalesce(F.when(a["score"].isNotNull() | a["covered"].isNotNull(), a), F.when(b["score"].isNotNull() | b["covered"].isNotNull(), b), F.struct(F.lit(0.0).alias("score"), F.lit("").alias("reasoning"), F.lit(None).cast("array<boolean>").alias("covered")))


def covered_share(covered: Column, n: Column) -> Column:
    """True verdicts among the first n, over n."""
    return F.size(F.filter(F.slice(covered, F.lit(1), n), lambda x: x)) / n


def key_form(c: Column) -> Column:
    """A key's letters and digits in lower case."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", ""))


def fields(records: DataFrame, names: tuple[str, ...], key: str = "record_id", payload: str = "payload") -> DataFrame:
    """(key, fields): the payload's fields as a struct, whatever the spelling of its keys; null where it isn't JSON.

    Where two keys come down to one field, the one last in the object's text counts.
    """
    entries = F.transform(F.map_entries(F.from_json(payload, "map<string,string>")), lambda e: F.struct(key_form(e["key"]).alias("k"), e["value"].alias("v")))

    def pick(f: str) -> Column:
        found = F.filter(F.col("__e"), lambda e: e["k"] == key_form(F.lit(f)))
        return F.try_element_at(F.transform(found, lambda e: e["v"]), F.lit(-1)).alias(f)

    return records.select(key, entries.alias("__e")).select(key, F.struct(*[pick(f) for f in names]).alias("fields"))


def objects(raw: Column, schema: str) -> Column:
    """ARRAY of objects that a model wrote: parsed as it is, with typographic quotes mended, or object by object."""
    many = f"array<{schema}>"
    mended = F.replace(F.replace(F.translate(raw, "‘’", "''"), F.lit("“"), F.lit('\\"')), F.lit("”"), F.lit('\\"'))
    single = F.filter(F.transform(F.regexp_extract_all(raw, F.lit(r"\{[^{}]+\}"), 0), lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, schema))), lambda x: x.isNotNull())
    whole = lambda x: F.when(F.try_parse_json(x).isNotNull(), F.from_json(x, many))
    return F.coalesce(whole(raw), whole(mended), F.when(F.size(single) > 0, single))
