"""PII: information-theoretic sanitisation with DataFrame functions only.

Protected entities are what the base patterns find: e-mail addresses, IPv4
addresses, payment cards and phone numbers. A term that shares
documents with an entity reveals it as far as knowing the term lowers the entity's
information content: with n documents, PMI(t; e) = log2(n * n_te / (n_t * n_e)) and
IC(e) = log2(n / n_e). Terms with PMI >= ``disclosure`` * IC that at least
``min_contexts`` documents share with the entity, at any distance, are spans as well,
in all documents that hold both. ``sanitise`` generalises entities to their kinds and
removes revealing terms.

All four counts are of different whole texts over all documents, so that copies count
once. Positions are code points; nothing but built-in functions runs. The patterns
below match what the plain ones match, but without nested repetition, so that long
runs of letters or digits take linear time.

Defined cases: a null text counts as empty and has no spans (``sanitise`` leaves
it null); rows with the same id share the terms found in any of them; a null id
gets base spans only; an empty table gives an empty result; other columns pass
through ``sanitise`` untouched, but those named ``__vl_*`` are reserved and dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, without_helpers

KINDS = ("email", "ip", "card", "phone", "term")
BASE = KINDS[:4]
MIN_CONTEXTS = 3
DISCLOSURE = 0.8
CHUNK = 256

_MARK, _OTHER = "", ""
_LOCAL = "A-Za-z0-9._%+-"
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++{_MARK}[A-Za-z0-9{_MARK}-]*+"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9][0-9{_MARK}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def bind(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _marked(text: Column, pattern: str) -> Column:
    """The text, as long as before, with the single characters that ``pattern`` matches turned into marks."""
    return F.regexp_replace(F.translate(text, _MARK, _OTHER), pattern, _MARK)


def _starts(lengths: Column) -> Column:
    """Running sums before each element, in chunks so that long arrays take little more than linear time."""
    zero = F.lit(0)

    def by_chunk(x: Column) -> Column:
        chunks = F.transform(F.sequence(zero, F.floor((F.size(x) - 1) / CHUNK).cast("int")), lambda b: F.aggregate(F.slice(x, b * CHUNK + 1, CHUNK), zero, lambda a, y: a + y))
        bases = lambda c: F.transform(F.sequence(zero, F.size(c) - 1), lambda b: F.aggregate(F.slice(c, 1, b), zero, lambda a, y: a + y))
        at = lambda i: F.floor(i / CHUNK).cast("int")
        return bind(bind(chunks, bases), lambda base: F.transform(F.sequence(zero, F.size(x) - 1), lambda i: F.get(base, at(i)) + F.aggregate(F.slice(x, at(i) * CHUNK + 1, i % CHUNK), zero, lambda a, y: a + y)))

    return by_chunk(lengths)


def _found(text: Column, pattern: Column | str, kind: int) -> Column:
    """array<struct<start, kind, end, match>> of all matches, leftmost first and without overlap."""
    pattern = F.lit(pattern) if isinstance(pattern, str) else pattern
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")

    def place(both: Column) -> Column:
        gaps, matches = both["g"], both["m"]
        lengths = F.transform(F.sequence(F.lit(0), F.size(matches) - 1), lambda i: F.length(F.get(gaps, i)) + F.length(F.get(matches, i)))
        span = lambda s: lambda i: F.struct(
            (F.get(s, i) + F.length(F.get(gaps, i))).alias("start"), F.lit(kind).alias("kind"),
            (F.get(s, i) + F.length(F.get(gaps, i)) + F.length(F.get(matches, i))).alias("end"), F.get(matches, i).alias("match"),
        )
        return F.when(F.size(matches) == 0, none).otherwise(bind(bind(lengths, _starts), lambda s: F.transform(F.sequence(F.lit(0), F.size(matches) - 1), span(s))))

    return bind(text, lambda t: bind(F.struct(F.split(t, pattern, -1).alias("g"), F.regexp_extract_all(t, pattern, F.lit(0)).alias("m")), place))


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    last_first = F.split(F.reverse(digits), "")
    worth = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0))
    return F.aggregate(F.transform(F.filter(last_first, lambda c: c != ""), worth), F.lit(0), lambda a, x: a + x) % 10 == 0


def base_spans(text: Column) -> Column:
    """array<struct<start, kind, end, match>> of the protected entities by start, then kind."""
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    small = lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.concat(F.lit("0"), F.substring(F.ltrim(p, F.lit("0")), 1, 3)).cast("int") <= 255)
    n = lambda s: F.length(_digits(s["match"]))
    card = lambda s: (n(s) >= 12) & (n(s) <= 19) & luhn(F.when(n(s) <= 19, _digits(s["match"])).otherwise("1"))
    emails = F.when(F.contains(text, F.lit("@")), _found(_marked(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])"), _EMAIL, 0)).otherwise(none)
    ips = F.when(text.rlike(r"[0-9]\.[0-9]"), F.filter(_found(text, _IP, 1), lambda s: F.forall(F.split(s["match"], r"\."), small))).otherwise(none)
    cards = F.when(text.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), F.filter(_found(_marked(text, r"(?<=[0-9])[\x20-](?=[0-9])"), _CARD, 2), card)).otherwise(none)
    phones = F.when(text.rlike(r"\+[0-9]"), F.filter(_found(text, _PHONE, 3), lambda s: (n(s) >= 9) & (n(s) <= 15))).otherwise(none)
    return F.sort_array(F.concat(emails, ips, cards, phones))


def _entity(kind: Column, match: Column) -> Column:
    """The name under which an entity is counted: its kind and its characters without marks, spaces or case."""
    return F.concat(kind.cast("string"), F.lit(":"), F.lower(F.when(kind.isin(2, 3), _digits(match)).otherwise(F.translate(match, _MARK, "."))))


def _terms(text: Column) -> Column:
    """The different words of a text, runs of at least three letters in lower case."""
    return F.filter(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), lambda w: F.length(w) >= 3)


def _different(docs: DataFrame) -> tuple[DataFrame, int]:
    """The different texts of ``docs`` (key, text), each once, and their number. Where few texts have copies the others do not move."""
    copied = stage(docs.groupBy("key").agg(F.count("*").alias("copies")).where("copies > 1"), "copied-texts")
    once, again = docs.join(copied, "key", "left_anti"), docs.join(copied, "key", "left_semi")
    more = copied.agg(F.coalesce(F.sum(F.col("copies") - 1), F.lit(0))).first()[0]
    return once.select("text").unionByName(again.select("text").distinct()), docs.count() - more


def revealing_terms(docs: DataFrame, *, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """(id, terms) for the documents (id, text) whose entities some of their terms reveal."""
    docs = docs.withColumn("key", F.xxhash64("text"))
    names = F.array_distinct(F.transform(base_spans(F.col("text")), lambda s: _entity(s["kind"], s["match"])))
    held = stage(docs.select("id", "key", "text", names.alias("entities")).where(F.size("entities") > 0).select("id", "key", "entities", _terms(F.col("text")).alias("terms")), "entities")
    texts, n = _different(docs.select("key", "text"))
    n = F.lit(n).cast("double")
    own = held.select("key", F.explode("entities").alias("entity")).distinct()
    # n_te is at most n_e, so that terms in more than ``most`` documents can't reach the threshold: common words never meet the entities
    most = F.col("n_e") * F.pow(n / F.col("n_e"), F.lit(1 - disclosure)) * (1 + 1e-9)
    with_entity = stage(own.groupBy("entity").agg(F.count("*").alias("n_e")).where((F.col("n_e") >= min_contexts) & (F.col("n_e") < n)).withColumn("most", most), "entity-counts")
    entities = stage(own.join(with_entity, "entity"), "entity-texts")
    top = with_entity.agg(F.coalesce(F.max("most"), F.lit(0.0))).first()[0]
    with_term = stage(texts.select(F.explode(_terms(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_t")).where(F.col("n_t").between(min_contexts, top)), "term-counts")
    words = stage(held.select("key", F.explode("terms").alias("term")).join(with_term, "term"), "text-terms")
    # copies of a text give the same rows once: ``entities`` is distinct by text, and so are its terms
    near = stage(entities.join(words.distinct(), "key").where(F.col("n_t") <= F.col("most")).select("key", "entity", "term", "n_e", "n_t"), "entity-terms")
    counted = near.groupBy("entity", "term", "n_e", "n_t").agg(F.count("*").alias("n_te"))
    pmi = F.log2(n * F.col("n_te") / (F.col("n_t").cast("double") * F.col("n_e")))
    telling = stage(counted.where((F.col("n_te") >= min_contexts) & (pmi >= disclosure * F.log2(n / F.col("n_e")))).select("entity", "term"), "telling")
    # a text's terms come together before they meet its copies: a row for each document, and not for each of its terms
    told = near.join(telling, ["entity", "term"]).groupBy("key").agg(F.collect_set("term").alias("terms"))
    each = held.where(F.col("id").isNotNull()).select("id", "key").distinct().join(told, "key")
    return stage(each.groupBy("id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("terms")))).alias("terms")), "disclosing")


def _with_spans(docs: DataFrame, id_col: str, text_col: str, min_contexts: int, disclosure: float) -> DataFrame:
    """``docs`` with ``__vl_base`` and ``__vl_terms``, arrays of spans; term spans do not overlap base spans."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    told = revealing_terms(docs.select(F.col(id_col).alias("id"), text.alias("text")), min_contexts=min_contexts, disclosure=disclosure)
    rows = docs.withColumn("__vl_base", base_spans(text)).join(told.select(F.col("id").alias("__vl_id"), F.col("terms").alias("__vl_told")), F.col(id_col) == F.col("__vl_id"), "left")
    none = F.array().cast("array<struct<start:int,kind:int,end:int,match:string>>")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), F.array_join("__vl_told", "|"), F.lit(r")(?![\p{L}\p{N}])"))
    apart = lambda s: ~F.exists("__vl_base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
    return rows.withColumn("__vl_terms", F.when(F.col("__vl_told").isNull(), none).otherwise(F.filter(_found(text, pattern, 4), apart))).drop("__vl_id", "__vl_told")


def _told(spans: Column) -> Column:
    kind = lambda k: F.get(F.array(*map(F.lit, KINDS)), k)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kind(s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row."""
    rows = _with_spans(docs.select(id_col, text_col), id_col, text_col, min_contexts, disclosure)
    count = lambda k: F.size(F.filter("__vl_base", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(BASE)]
    return rows.select(id_col, *counts, F.sha2(_told(F.col("__vl_base")), 256).alias("base_sha256"), _told(F.sort_array(F.concat("__vl_base", "__vl_terms"))).alias("spans"))


def sanitise(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """``docs`` with entities generalised to ``<EMAIL>``, ``<IP>``, ``<CARD>``, ``<PHONE>`` and revealing terms removed (``<TERM>``). Of overlapping spans the first by start gives the tag and the text up to the end of the last goes."""
    docs = without_helpers(docs)
    rows = _with_spans(docs, id_col, text_col, min_contexts, disclosure)
    text = F.col(text_col)
    spans = F.sort_array(F.concat("__vl_base", "__vl_terms"))

    def merged(s: Column) -> Column:
        start = F.array().cast("array<struct<start:int,kind:int,end:int>>")
        one = lambda x, a, k, e: F.struct(a.alias("start"), k.alias("kind"), e.alias("end"))

        def add(acc: Column, x: Column) -> Column:
            last = F.element_at(acc, -1)
            fresh = F.concat(acc, F.array(one(x, x["start"], x["kind"], x["end"])))
            joined = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(one(x, last["start"], last["kind"], F.greatest(last["end"], x["end"]))))
            return F.when(F.size(acc) == 0, fresh).when(x["start"] >= last["end"], fresh).otherwise(joined)

        return F.aggregate(s, start, add)

    tags = F.array(*(F.lit(f"<{k.upper()}>") for k in KINDS))

    def rewrite(m: Column) -> Column:
        end = lambda i: F.when(i == 0, 0).otherwise(F.get(m, i - 1)["end"])
        part = lambda i: F.concat(
            F.when(i == 0, "").otherwise(F.get(tags, F.get(m, i - 1)["kind"])),
            F.when(i < F.size(m), F.substring(text, end(i) + 1, F.get(m, i)["start"] - end(i))).otherwise(F.substring(text, end(i) + 1, F.length(text))),
        )
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(m)), part), "")

    clean = F.when(text.isNull() | (F.size("__vl_base") + F.size("__vl_terms") == 0), text).otherwise(bind(bind(spans, merged), rewrite))
    return rows.select(*(clean.alias(c) if c == text_col else F.col(c) for c in docs.columns))
