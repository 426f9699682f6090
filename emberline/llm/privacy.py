"""Personal data: pattern spans, and terms that reveal a protected value by corpus co-occurrence."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from emberline.llm.tables import cut, is_empty, joinable, without

KINDS = ["email", "ip", "card", "phone"]
GENERALISE, REMOVE = 1.0, 0.1  # bits of uncertainty about a value that a term may leave at most
Z = 1.0  # standard errors by which a term's share of texts with the value is taken lower than counted
_LETTERS = r"[^\p{L}]+"
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = regex.compile(r"\p{L}{3,}")
_LABEL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "generalise": "[TERM]", "remove": ""}


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of local@domain, found from each @ so that long runs without one cost nothing."""
    free, at = 0, text.find("@")
    last = -1
    while at >= 0:
        floor = max(free, last + 1)
        run = _LOCAL.match(text[floor:at][::-1])
        host = _DOMAIN.match(text, at + 1) if run else None
        if host:
            yield at - run.end(), host.end()
            free = host.end()
        last, at = at, text.find("@", at + 1)


def _luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def _octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind as in KINDS, then by start."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16:
            digits = m[0].replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and _luhn(digits):
                found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _parsed(spans: str) -> list[tuple[str, int, int]]:
    return [(k, int(a), int(b)) for k, a, b in (s.split(":") for s in spans.split(",") if s)]


@F.pandas_udf(StructType([StructField("spans", StringType()), StructField("values", ArrayType(StringType()))]))
def _base(texts: pd.Series) -> pd.DataFrame:
    spans, values = [], []
    for t in texts:
        found = base_spans(t) if t else []
        spans.append(joined(found))
        values.append(sorted({f"{k}:{t[a:b].lower() if k in ('email', 'ip') else re.sub('[^0-9]', '', t[a:b])}" for k, a, b in found}))
    return pd.DataFrame({"spans": spans, "values": values})


@F.pandas_udf(StringType())
def _term_spans(texts: pd.Series, terms: pd.Series, removed: pd.Series) -> pd.Series:
    """Spans of the listed terms outside the base spans: those to generalise, then those to remove."""
    out = []
    for text, listed, gone in zip(texts, terms, removed):
        listed, gone = set(listed), set(gone)
        taken = sorted((a, b) for _, a, b in base_spans(text))
        found, i = [], 0
        for m in _WORD.finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if (i == len(taken) or taken[i][0] >= m.end()) and (word := m[0].lower()) in listed:
                found.append(("remove" if word in gone else "generalise", *m.span()))
        out.append(joined(sorted(found)))
    return pd.Series(out, dtype=object)


@F.pandas_udf(StringType())
def _clean(texts: pd.Series, spans: pd.Series) -> pd.Series:
    out = []
    for text, listed in zip(texts, spans):
        if text is None or not listed:
            out.append(text)
            continue
        parts, at = [], 0
        for kind, a, b in sorted(_parsed(listed), key=lambda s: (s[1], -s[2])):
            if a >= at:
                parts += [text[at:a], _LABEL[kind]]
            at = max(at, b)
        out.append("".join([*parts, text[at:]]))
    return pd.Series(out, dtype=object)


def _entities(owners: DataFrame) -> DataFrame:
    """(h, entity) from (h, value): values found in the very same texts have the same statistics and are one entity.

    So a text that alone holds thousands of values meets its own terms once, not once per value.
    """
    mark = F.struct(F.count("*"), F.bit_xor(F.xxhash64("h")), F.bit_xor(F.xxhash64("h", F.lit(1))))
    named = owners.groupBy("value").agg(F.xxhash64(mark).alias("entity"))
    return owners.join(named, "value").select("h", "entity").distinct()


def share_at_least(both: Column, df: Column) -> Column:
    """Lower confidence bound (Wilson's, Z standard errors) of the share both / df."""
    p, z2 = both / df, Z * Z
    return (p + z2 / (2 * df) - Z * F.sqrt(p * (1 - p) / df + z2 / (4 * df * df))) / (1 + z2 / df)


def revealing_terms(docs: DataFrame, marked: DataFrame, copies: DataFrame) -> DataFrame:
    """(h, terms, removed) per text: its terms that disclose a value found anywhere in the corpus.

    docs: (h, text) of all rows; marked: (h, entity); copies: (h, n) of the texts that are there n > 1 times. All counts
    are of distinct texts: a row of a text with n copies counts 1/n. A term leaves -log2 P(value | term) bits of
    uncertainty about the value; P is the lower confidence bound of the share of the term's texts that hold the value,
    so what a term discloses depends on its own evidence and neither on the size of the corpus nor on copies.

    The term frequencies are one count combined per task. A term that occurs with the value only is found in the texts
    that hold the value, which are looked at anyway; the rest of the corpus is only searched for the others.
    """
    terms = F.transform(F.filter(F.split("text", _LETTERS), lambda x: F.length(x) >= 3), lambda x: F.lower(x))
    terms = F.array_distinct(terms)
    weighed = docs.join(joinable(copies), "h", "left").select("h", "text", (1 / F.coalesce("n", F.lit(1))).alias("w"))
    texts = docs.where(F.col("text").rlike("[0-9@]")).join(joinable(marked.select("h").distinct()), "h", "left_semi")
    held = cut(texts.select("h", F.explode(terms).alias("term")).distinct())
    counted = held.join(marked, "h").groupBy("entity", "term").agg(F.count("*").alias("both"))
    frequent = weighed.select("w", F.explode(terms).alias("term")).groupBy("term").agg(F.sum("w").alias("df"))
    known = counted.join(frequent, "term").withColumn("df", F.greatest(F.round("df"), F.col("both")))
    left = -F.log2(share_at_least(F.col("both"), F.col("df")))
    strong = known.groupBy("term").agg(F.min(left).alias("left"), F.max(F.col("both") < F.col("df")).alias("elsewhere")).where(F.col("left") <= GENERALISE + 1e-9)
    strong = cut(strong)
    hits = held.join(joinable(strong), "term").select("h", "term", "left")
    elsewhere = strong.where("elsewhere")
    if not is_empty(elsewhere):
        hits = hits.unionAll(docs.select("h", F.explode(terms).alias("term")).join(joinable(elsewhere), "term").select("h", "term", "left"))
    return hits.groupBy("h").agg(F.collect_set("term").alias("terms"), F.collect_set(F.when(F.col("left") <= REMOVE, F.col("term"))).alias("removed"))


def sanitise(docs: DataFrame) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone, base_sha256, spans and clean_text to every row.

    The base patterns are matched over whole texts. Every distinct value they find, be it in one text only, is a
    protected entity; terms (runs of three or more letters, lower-cased) whose corpus co-occurrence leaves at most
    GENERALISE bits of uncertainty about it are added as spans of kind generalise, at most REMOVE bits of kind remove,
    in every text that contains the term. So a word that stands in the only text with a value is generalised there, and
    it takes 14 distinct texts to remove one. clean_text carries a label per span and drops removed terms; overlapping
    spans share one label.

    A null text is empty and stays null in clean_text. Texts without personal data are unchanged. Null ids and repeated
    rows are rows like any other; copies share their spans. An empty table gives an empty result. Extra columns pass
    through; input columns named like an output column give way. Matching is linear in the text's length.
    """
    docs = without(docs, [*[f"n_{k}" for k in KINDS], "base_sha256", "spans", "clean_text"])
    keyed = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    base = cut(keyed.select("doc_id", "h", _base("text").alias("b")).select("doc_id", "h", "b.spans", "b.values"))
    owners = base.where(F.size("values") > 0).select("h", F.explode("values").alias("value")).distinct()
    marked = cut(_entities(owners))
    labels = base.select("doc_id", "h", "spans").distinct()
    if is_empty(marked):
        labels = labels.withColumn("more", F.lit(""))
    else:
        copies = base.groupBy("h").agg(F.count("*").alias("n")).where("n > 1")
        terms = joinable(revealing_terms(keyed, marked, copies))
        found = keyed.join(terms, "h").select("h", _term_spans("text", "terms", "removed").alias("more")).dropDuplicates(["h"])
        labels = labels.join(found, "h", "left")
    whole = labels.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h"), F.col("spans").alias("__base"), F.concat_ws(",", F.nullif("spans", F.lit("")), F.nullif("more", F.lit(""))).alias("spans"))
    out = docs.withColumn("__t", F.xxhash64("text")).join(whole, F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__t") == F.col("__h")))
    kinds = F.transform(F.split("__base", ","), lambda s: F.substring_index(s, ":", 1))
    counts = {f"n_{k}": (F.array_size(kinds) - F.array_size(F.array_remove(kinds, k))).cast("long") for k in KINDS}
    out = out.withColumns(counts).withColumn("base_sha256", F.sha2("__base", 256))
    return out.withColumn("clean_text", _clean("text", "spans")).drop("__t", "__d", "__h", "__base")
