"""Personal data: exact patterns, and terms that disclose what the patterns protect.

Base spans are leftmost, non-overlapping matches per kind (email, ip, card, phone);
the value they hold is a protected entity. Information-theoretic sanitisation then
asks which other terms give an entity away. For a term t in the word window around
mentions of an entity e, corpus counts over all documents give

    IC(e) = -log2 p(e)        PMI(t, e) = log2 p(t, e) / (p(t) p(e))

PMI reaches IC(e) when t never occurs without e. It is taken at the lower end of what
the different windows around e that hold t bear out: with p(e | t) at the lower bound
of its Wilson interval (``z``), so that copies of one passage count once, and one window
is weak evidence but not none. Terms whose PMI is at least ``remove`` x IC(e) are
removed, those at or above ``generalise`` x IC(e) are generalised, in the documents that
mention e.

Defined cases: a null text is empty and has no spans; offsets are code points, ends
exclusive; rows that share a document id are each sanitised, and share the terms
found for that id; a null id is an id of its own; an empty table gives no rows; texts of
any length, with any number of mentions, are read whole in time that grows with both.
Extra columns, of any name, never reach the search; the stage keeps them as they are.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from marketlens.llm.common import lean, quoted, stored

KINDS = ("email", "ip", "card", "phone")
# The patterns of the contract, with their groups left out.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start where a run of digits starts: later starts in a run match no more.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[^0-9]+")

WINDOW_WORDS = 5
#: Rows of a result batch, about.
ROWS_AT_ONCE = 10_000
SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their at signs: linear in the text."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    out += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
            if all(int(x.lstrip("0")[:4] or 0) <= 255 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _DIGITS.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_DIGITS.sub("", m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def entity(kind: str, value: str) -> str:
    """The protected value: an address in lower case, or a number's digits."""
    return f"{kind}:{value.lower()}" if kind == "email" else f"{kind}:{value}" if kind == "ip" \
        else f"{kind}:{_DIGITS.sub('', value)}"


def _word_pattern():
    import regex
    return regex.compile(r"\p{L}{3,}")


def _fold(word: str) -> str:
    """Lower-case A-Z only, as the corpus counts do."""
    return word if word.islower() else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in word)


def _free_between(cover: list[tuple[int, int]]):
    """Whether start to end touches none of the spans; of those that start before its end, the furthest end decides."""
    starts = [s for s, _ in cover]
    furthest = list(accumulate((e for _, e in cover), max))

    def free(start: int, end: int) -> bool:
        k = bisect_left(starts, end)
        return k == 0 or furthest[k - 1] <= start
    return free


def _outside(cover: list[tuple[int, int]]):
    """Whether a match touches none of the spans."""
    free = _free_between(cover)
    return lambda m: free(m.start(), m.end())


def _windows(batches):
    """(id, entity, context, term) for the words around every mention, and (id, null, null, term) for
    all words of a text with mentions."""
    words = _word_pattern()
    for b in batches:
        rows = ([], [], [], [])

        def batch():
            return pa.RecordBatch.from_arrays(
                [pa.array(rows[0], b.schema.field(0).type), *(pa.array(c, pa.string()) for c in rows[1:])],
                names=["id", "entity", "context", "term"])

        def put(*row):
            for col, x in zip(rows, row):
                col.append(x)

        # A text at a time, and its results in batches of their own, however many mentions it has.
        for doc, text in zip(b.column(0), b.column(1)):
            doc, text = doc.as_py(), text.as_py()
            spans = base_spans(text or "")
            if not spans:
                continue
            cover = sorted((s, e) for _, s, e in spans)
            # The whole words of the text, so that none is cut and no window ends early.
            starts, ends, terms, same = [], [], [], {}
            for m in words.finditer(text):
                starts.append(m.start())
                ends.append(m.end())
                term = _fold(m[0])
                terms.append(same.setdefault(term, term))
            free = _free_between(cover)
            for kind, start, end in spans:
                before, after = bisect_right(ends, start), bisect_left(starts, end)
                near = [terms[i] for i in (*range(max(0, before - WINDOW_WORDS), before),
                                           *range(after, min(after + WINDOW_WORDS, len(terms)))) if free(starts[i], ends[i])]
                context, found = " ".join(near), entity(kind, text[start:end])
                for term in set(near):
                    put(doc, found, context, term)
                if len(rows[0]) >= ROWS_AT_ONCE:
                    yield batch()
                    rows = ([], [], [], [])
            for term in set(terms):
                put(doc, None, None, term)
            if len(rows[0]) >= ROWS_AT_ONCE:
                yield batch()
                rows = ([], [], [], [])
        yield batch()


def disclosing_terms(docs: DataFrame, *, z: float = 1.64, generalise: float = 0.75, remove: float = 0.9) -> DataFrame:
    """(id, terms): for every document the terms in it that disclose an entity it mentions.

    ``docs`` has id and text. ``terms`` is an array of (term, action).
    """
    schema = StructType([StructField("id", docs.schema["id"].dataType),
                         *[StructField(c, StringType()) for c in ("entity", "context", "term")]])
    found = stored(docs.mapInArrow(lean("pii", _windows), schema), "pii-windows")
    seen = found.where(F.col("entity").isNotNull())
    ids = F.countDistinct("id") + F.max(F.col("id").isNull().cast("int"))  # a null id is one
    joint = seen.groupBy("entity", "term").agg(F.countDistinct("context").alias("contexts"), ids.alias("n_te"))
    n_e = seen.groupBy("entity").agg(ids.alias("n_e"))
    n = float(max(1, docs.count()))
    ic = -F.log2(F.col("n_e") / F.lit(n))

    def share(n_t: str):
        """PMI over IC, were the term in ``n_t`` documents; it falls as these grow."""
        p = F.least(F.lit(1.0), F.col("n_te") / F.col(n_t))
        m = F.col("contexts") / p  # windows with and without the entity
        low = (p + z * z / (2 * m) - z * F.sqrt(p * (1 - p) / m + z * z / (4 * m * m))) / (1 + z * z / m)
        return F.when(ic > 0, 1 + F.log2(low) / ic).otherwise(F.lit(0.0))

    # A term is in at least the documents whose windows hold it: pairs that fall short
    # even at that count are out before the corpus is counted.
    n_w = seen.groupBy("term").agg(ids.alias("n_w"))
    joint = stored(joint.join(n_w, "term").join(n_e, "entity").where(share("n_w") >= generalise)
                   .select("entity", "term", "contexts", "n_te", "n_e"), "pii-joint")
    low = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"(\p{L}{3,})"), 1))).alias("term")
    # Counted map-side before the join: a join of occurrences grows with terms times documents
    # (and a semi join would be pushed below the count).
    n_t = (docs.select(words).groupBy("term").agg(F.count("*").alias("n_t"))
           .join(joint.select("term").distinct(), "term"))
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action")
    reveal = (joint.join(n_t, "term").withColumn("share", share("n_t"))
              .where(F.col("share") >= generalise).select("entity", "term", action))
    # By the words of the documents: an entity's terms are as many as its windows, and all of them
    # for each of its documents would be a square. Rows that share an id with a mention may have none.
    mentions = seen.select("id", "entity").distinct()
    again = docs.groupBy("id").agg(F.count("*").alias("rows")).where("rows > 1").select(F.col("id").alias("a_id"))
    again = stored(again.join(mentions.select("id").distinct(), F.col("a_id").eqNullSafe(F.col("id")), "left_semi"),
                   "pii-again")
    held = (found.where(F.col("entity").isNull()).select("id", "term")
            .unionByName(docs.join(again, F.col("id").eqNullSafe(F.col("a_id")), "left_semi").select("id", words)))
    mentions = mentions.select(F.col("id").alias("m_id"), F.col("entity").alias("m_entity"))
    return (held.join(reveal, "term")
            .join(mentions, F.col("id").eqNullSafe(F.col("m_id")) & (F.col("entity") == F.col("m_entity")), "left_semi")
            .groupBy("id").agg(F.collect_set(F.struct("term", "action")).alias("terms")))


def _spans(with_text: bool):
    def clean(text, spans, action):
        out, at = [], 0
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if start < at:
                continue
            out.append(text[at:start])
            if kind != "term":
                out.append(f"[{kind.upper()}]")
            elif action[start] == "generalise":
                out.append("[WORD]")
            at = end
        return "".join(out) + text[at:]

    def merged(spans):
        """Spans for replacing: overlapping ones of several kinds become one, named by the first."""
        out = []
        for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
            if out and start < out[-1][2]:
                out[-1] = (out[-1][0], out[-1][1], max(end, out[-1][2]))
            else:
                out.append((kind, start, end))
        return out

    def run(batches):
        words = _word_pattern()
        for b in batches:
            found, cleaned = [], []
            for text, terms in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                text = text or ""
                spans, action = base_spans(text), {}
                if terms:
                    what = {t["term"]: t["action"] for t in sorted(terms, key=lambda t: (t["term"], t["action"]))}
                    free = _outside(sorted((s, e) for _, s, e in spans))
                    for m in words.finditer(text):
                        if (act := what.get(_fold(m[0]))) and free(m):
                            spans.append(("term", m.start(), m.end()))
                            action[m.start()] = act
                found.append([{"kind": k, "start": s, "end": e} for k, s, e in spans])
                if with_text:
                    cleaned.append(clean(text, merged(spans), action) if spans else text)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
            cols, names = [b.column(0), pa.array(found, kind)], ["id", "spans"]
            if with_text:
                cols, names = cols + [pa.array(cleaned, pa.string())], names + ["clean_text"]
            yield pa.RecordBatch.from_arrays(cols, names=names)
    return run


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", carry: Column | None = None,
             with_text: bool = True, **thresholds) -> DataFrame:
    """id, spans (kind, start, end) and, if asked for, clean_text of every row.

    ``carry`` replaces the id in the result by another column expression, such as a
    struct of the whole row.
    """
    base = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    terms = stored(disclosing_terms(base, **thresholds), "pii-terms").select(F.col("id").alias("t_id"), "terms")
    src = (docs.select(F.col(id_col).alias("j_id"), (F.col(id_col) if carry is None else carry).alias("id"),
                       F.col(text_col).alias("text"))
           .join(terms, F.col("j_id").eqNullSafe(F.col("t_id")), "left").select("id", "text", "terms"))
    schema = StructType([StructField("id", src.schema["id"].dataType), StructField("spans", SPANS)])
    out = src.mapInArrow(lean("pii", _spans(with_text)), schema.add("clean_text", StringType()) if with_text else schema)
    return out.withColumnRenamed("id", id_col if carry is None else "carried")


def sanitised(docs: DataFrame, **thresholds) -> DataFrame:
    """``docs`` with masked texts, and n_chars following them if there is such a column; nulls stay null."""
    row = F.struct(*[F.col(quoted(c)) for c in docs.columns])
    out = sanitise(docs, carry=row, **thresholds)
    text = F.when(F.col("carried.text").isNotNull(), F.col("clean_text"))
    value = {"text": text}
    if "n_chars" in docs.columns:
        value["n_chars"] = F.when(text.isNotNull(), F.char_length(text)).otherwise(F.col("carried.n_chars")) \
            .cast(docs.schema["n_chars"].dataType)
    return out.select(*[value.get(c, F.col(f"carried.{quoted(c)}")).alias(c) for c in docs.columns])


def digest(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, base digest and span list of every document, from its spans."""
    base = F.filter("spans", lambda s: s["kind"] != "term")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(id_col, *[count(k) for k in KINDS], F.sha2(digest(base), 256).alias("base_sha256"),
                        digest(F.col("spans")).alias("spans"))
