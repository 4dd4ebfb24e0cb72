"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

One scan finds the base spans of every whole text and, as candidates, all
identifier-like tokens and all values behind a key (short ones, ones without a
digit and quoted ones with blanks too), with the lexical patterns around them:
the key directly in front (``name=``), its last part (``token`` of
``access_token``) alone and with the characters that the value is made of, the
form of a long token (first letters and length), the word before, and the words
on both sides. Plain words that follow the same word elsewhere in the text are
instances too, which count against it: ``the`` says nothing, however often
an address follows it. Base matches seed the pattern-instance graph, and so do
credentials: values that look like one behind a key that names one, and tokens
of a published form. Spark then scores it in rounds: a pattern scores by the share of its
distinct instances that are believed and by how many there are; an instance is
believed by noisy-or over its patterns. Each round is written. Candidates in
contexts of a confident pattern are added as spans of kind ``id``; the base
spans always stay. Added spans may lie inside each other (a token of a quoted
value); none touches a base span.

The scan is linear in the text, also for runs of letters or digits without end:
an address is looked for backwards from each ``@`` and a dotted number starts
only where a run of digits does.

Rules for odd input: a null text is empty and has no spans. Documents are
judged row by row, so a doc_id on several rows gives as many result rows, each
with the spans of its own text; a null doc_id is a value like any other. Extra columns are ignored by ``find``
and carried by ``mask``. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.batches import BATCH_ROWS, map_lists, ship
from tillbook.llm.rows import near_keys, text_key, whole
from tillbook.session import written

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"

# A pattern counts with at least so many distinct instances, of which this share is believed.
MIN_INSTANCES = 5
MIN_CONFIDENCE = 0.8
ROUNDS = 3

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# An identifier-like token: letters or digits with at least one digit, seven characters or more.
TOKEN = re.compile(r"(?<![A-Za-z0-9])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9][A-Za-z0-9_-]{6,}")
DIGITS = re.compile(r"[^0-9]+")
# A key and its value, which is quoted or a bare token; looked for from each sign of assignment.
ASSIGNED = re.compile(r"[=:]")
KEY = re.compile(r"([A-Za-z][A-Za-z0-9_-]{1,29})[\"']?\s{0,2}\Z")
VALUE = re.compile(r"\s{0,2}(?:\"([^\"\n]{4,80})\"|'([^'\n]{4,80})'|([A-Za-z0-9][A-Za-z0-9_-]{3,}))")
KEY_PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+")
# Last parts of keys that name a credential. Fixed values.
CREDENTIALS = frozenset({"token", "secret", "password", "passwd", "pwd", "apikey", "credential", "credentials"})
# What looks like one: twenty characters or more without a blank, letters and digits both.
CREDENTIAL = re.compile(r"(?=[^0-9]*[0-9])(?=[^A-Za-z]*[A-Za-z])[A-Za-z0-9_+/=.-]{20,}")
# Published forms of access keys. Fixed values.
ACCESS_KEY = re.compile(r"A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}")
# A token whose form says something: two first letters and more, and sixteen characters at least.
FORM = re.compile(r"([A-Z]{4}|[a-z]{2,4}[_-])(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{12,}")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(map(int, reversed(digits))):
        doubled = digit * 2 if place % 2 else digit
        total += doubled - 9 if doubled > 9 else doubled
    return total % 10 == 0


def _emails(text: str) -> Iterator[Span]:
    at, free = text.find("@"), 0
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield "email", start, domain.end()
            free = domain.end()
        at = text.find("@", max(at + 1, free))


def base_spans(text: str) -> list[Span]:
    """Base spans by start, then by kind; offsets count code points."""
    found: list[Span] = list(_emails(text)) if "@" in text else []
    for match in IP.finditer(text):
        # int() refuses more than 4300 digits, leading zeros included.
        parts = [p.lstrip("0") or "0" for p in match.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            found.append(("ip", *match.span()))
    for match in CARD.finditer(text):
        digits = DIGITS.sub("", match.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *match.span()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= len(DIGITS.sub("", match.group())) <= 15:
                found.append(("phone", *match.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for kind, start, end in spans)


def _word_before(text: str, at: int) -> str:
    words = text[max(0, at - 40) : at].split()
    return _plain(words[-1]) if words else ""


def _word_after(text: str, at: int) -> str:
    words = text[at : at + 40].split(maxsplit=1)
    return _plain(words[0]) if words else ""


def _plain(word: str) -> str:
    return re.sub("[0-9]", "0", word.lower())


def _key_tail(key: str) -> str:
    """The last part of a key in either style: ``token`` of ``access_token`` and ``accessToken``."""
    parts = KEY_PARTS.findall(key)
    return parts[-1].lower() if parts else key.lower()


def _made_of(value: str) -> str:
    if re.fullmatch("[0-9]+", value):
        return "digits"
    if re.fullmatch("[0-9a-f]+|[0-9A-F]+", value):
        return "hex"
    return "mixed" if re.search("[0-9]", value) else "letters"


def _key_before(text: str, start: int) -> str | None:
    head = text[max(0, start - 40) : start].rstrip("\"'")
    head = head.rstrip()
    key = KEY.search(head[:-1]) if head.endswith(("=", ":")) else None
    return key.group(1) if key else None


def patterns_around(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place, the instance itself left out; a neighbour without a letter says nothing."""
    found, key = [], _key_before(text, start)
    if key:
        tail = _key_tail(key)
        found = [f"key {key.lower()}", f"tail {tail}", f"tail {tail} {_made_of(text[start:end])}"]
    form = FORM.fullmatch(text, start, end)
    if form:
        found.append(f"form {form.group(1)} {end - start}")
    before, after = _word_before(text, start), _word_after(text, end)
    if any(map(str.isalpha, before)):
        found.append(f"before {before}")
        if after:
            found.append(f"around {before} {after}")
    return found


def _values(text: str) -> Iterator[tuple[int, int]]:
    """Places of values behind a key."""
    for sign in ASSIGNED.finditer(text):
        at = sign.start()
        if KEY.search(text[max(0, at - 36) : at]):
            value = VALUE.match(text, at + 1)
            if value:
                yield value.span(value.lastindex)


def _is_seed(text: str, start: int, end: int) -> bool:
    if ACCESS_KEY.fullmatch(text, start, end):
        return True
    key = _key_before(text, start)
    return bool(key) and _key_tail(key) in CREDENTIALS and bool(CREDENTIAL.fullmatch(text, start, end))


def words_against(text: str, patterns: set[str]) -> Iterator[tuple[str, str]]:
    """Patterns of words and the plain words in their place elsewhere in the text."""
    words = _plain(text).split()
    for i, word in enumerate(words[:-1]):
        if f"before {word}" in patterns:
            inside = words[i + 1]
            if "0" not in inside and "@" not in inside:
                yield f"before {word}", inside
                if i + 2 < len(words) and f"around {word} {words[i + 2]}" in patterns:
                    yield f"around {word} {words[i + 2]}", inside


def candidates(text: str, base: list[Span]) -> list[tuple[int, int, str, list[str], bool, bool]]:
    """Start, end, instance, patterns, whether it is a seed and whether it is a base span."""
    found = [(s, e, text[s:e], patterns_around(text, s, e), True, True) for _, s, e in base]
    # Ends of the base spans so far, so that one look says whether a place touches any that starts before its end.
    starts, ends = [s for _, s, _ in base], []
    for _, _, e in base:
        ends.append(max(e, ends[-1] if ends else 0))
    for start, end in sorted({*_values(text), *(m.span() for m in TOKEN.finditer(text))}):
        place = bisect_left(starts, end)
        if not place or ends[place - 1] <= start:
            found.append((start, end, text[start:end], patterns_around(text, start, end), _is_seed(text, start, end), False))
    return found


def _number(value: str) -> int:
    return int.from_bytes(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


SCANNED = (
    "doc_id long, {key}, spans array<struct<kind:string,start:int,stop:int>>, base string,"
    " found array<struct<start:int,stop:int,instance:long,known:boolean,base:boolean,patterns:array<long>>>,"
    " against array<struct<pattern:long,instance:long>>"
)


def _scan(texts: list[str | None]) -> dict[str, list]:
    spans, base, found, against = [], [], [], []
    for text in texts:
        text = text or ""
        own = base_spans(text)
        places = candidates(text, own)
        spans.append([{"kind": k, "start": s, "stop": e} for k, s, e in own])
        base.append(joined(own))
        found.append(
            [
                {"start": s, "stop": e, "instance": _number(i), "known": known, "base": b, "patterns": [_number(p) for p in ps]}
                for s, e, i, ps, known, b in places
            ]
        )
        pairs = set(words_against(text, {p for place in places for p in place[3]})) if places else ()
        against.append([{"pattern": _number(p), "instance": _number(i)} for p, i in pairs])
    return {"spans": spans, "base": base, "found": found, "against": against}


def scan(docs: DataFrame, key: Column) -> DataFrame:
    """Base spans and candidates of every document, without its text but with what its spans go by (``key``)."""

    def run(columns: dict[str, list]) -> dict[str, list]:
        return {"doc_id": columns["doc_id"], "key": columns["key"], **_scan(columns["text"])}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("key"), "text")
    return map_lists(rows, run, SCANNED.replace("{key}", f"key {rows.schema['key'].dataType.simpleString()}"))


def _edges(scanned: DataFrame) -> DataFrame:
    """Distinct pattern-instance pairs, and whether the instance is a seed anywhere in them."""
    one = scanned.select(F.explode("found").alias("c"))
    pairs = one.select(F.explode("c.patterns").alias("pattern"), "c.instance", "c.known")
    words = scanned.select(F.explode("against").alias("a")).select("a.pattern", "a.instance", F.lit(False).alias("known"))
    pairs = pairs.union(words)
    return pairs.groupBy("pattern", "instance").agg(F.max("known").alias("known"))


def confident_patterns(
    edges: DataFrame,
    rounds: int = ROUNDS,
    min_instances: int = MIN_INSTANCES,
    min_confidence: float = MIN_CONFIDENCE,
) -> DataFrame:
    """Patterns (column ``pattern``) whose confidence reaches the threshold after the last round.

    Confidence is the mean belief in the distinct instances, taken down by one
    unbelieved instance, so that few instances can't make a sure pattern.
    """
    edges = written(edges, "edges")
    believed = edges.where("known").select("instance", F.lit(1.0).alias("belief")).distinct()
    for _ in range(rounds):
        believed = written(believed, "belief")
        scored = edges.join(believed, "instance", "left").groupBy("pattern")
        sums = scored.agg(F.sum(F.coalesce("belief", F.lit(0.0))).alias("mass"), F.count("*").alias("instances"))
        scores = sums.select("pattern", (F.col("mass") / (F.col("instances") + 1)).alias("confidence"), "instances")
        sure = written(scores.where((F.col("instances") >= min_instances) & (F.col("confidence") >= min_confidence)), "patterns")
        doubt = edges.where("NOT known").join(sure, "pattern").groupBy("instance")
        noisy_or = doubt.agg((1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("confidence"), F.lit(1e-6)))))).alias("belief"))
        seeds = edges.where("known").select("instance", F.lit(1.0).alias("belief"))
        believed = seeds.union(noisy_or).groupBy("instance").agg(F.max("belief").alias("belief"))
    return sure.select("pattern")


def _discovered(scanned: DataFrame, patterns: DataFrame) -> DataFrame:
    """The added spans by key, in order."""
    one = scanned.select("key", F.explode("found").alias("c")).where("NOT c.base")
    placed = one.select("key", "c.start", "c.stop", F.explode("c.patterns").alias("pattern"))
    spans = placed.join(patterns, "pattern", "left_semi").select("key", "start", "stop").distinct()
    span = F.struct(F.lit(FOUND).alias("kind"), "start", "stop")
    return spans.groupBy("key").agg(F.collect_list(span).alias("more"))


def _found(docs: DataFrame, key: Column) -> tuple[DataFrame, DataFrame]:
    scanned = written(scan(docs, key), "scan")
    return scanned, written(_discovered(scanned, confident_patterns(_edges(scanned))), "discovered")


def find(docs: DataFrame) -> DataFrame:
    """One row per document: counts by kind, digest of the base spans, all spans, n_id."""
    # Rows are numbered in the written scan.
    scanned, more = _found(docs, F.monotonically_increasing_id())
    both = scanned.join(more, "key", "left")
    # Sorted by start, then kind as listed.
    order = F.expr(f"""transform(array_sort(transform(concat(spans, coalesce(more, array())),
        s -> struct(s.start AS start, array_position(array({', '.join(f"'{k}'" for k in (*KINDS, FOUND))}), s.kind) AS rank, s AS s))),
        x -> concat_ws(':', x.s.kind, x.s.start, x.s.stop))""")
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long)").alias(f"n_{k}") for k in KINDS]
    return both.select(
        "doc_id",
        *counts,
        F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
        F.concat_ws(",", order).alias("spans"),
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_id"),
    )


def masked(text: str, spans: list[Span]) -> str:
    """The text with every span replaced by its kind; overlapping spans become one, named by the first."""
    parts, at = [], 0
    for kind, start, end in sorted(spans, key=lambda s: (s[1], -s[2])):
        if start >= at:
            parts += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join(parts) + text[at:]


def mask(docs: DataFrame) -> DataFrame:
    """The documents with masked texts; n_chars, if there, is that of the new text.

    A null text stays null. Only documents with added spans are joined to them;
    the base spans are found again in the scan that masks them.
    """
    # Rows are read again, so the spans go by the text that they are places of.
    more = _found(docs, text_key())[1].select(F.col("key").alias("text_key"), "more")
    alone, others = near_keys(whole(docs, {"text_key": text_key()}), more, "text_key")
    none = F.lit(None).cast(more.schema["more"].dataType).alias("more")
    both = alone.select("row", none).union(others.join(more, "text_key", "left").select("row", "more"))
    place, docs_columns = docs.columns.index("text"), docs.columns
    ship(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))

    def new_text(text: str | None, added: list[dict] | None) -> str | None:
        if text is None:
            return None
        return masked(text, base_spans(text) + [(s["kind"], s["start"], s["stop"]) for s in added or ()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = batch.column("row").flatten()
            texts = zip(columns[place].to_pylist(), batch.column("more").to_pylist(), strict=True)
            columns[place] = pa.array([new_text(*t) for t in texts], columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    done = both.mapInArrow(run, docs.schema)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        done = done.withColumn("n_chars", F.coalesce(F.char_length("text").cast(kind), F.col("n_chars")))
    return done
