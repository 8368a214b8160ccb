"""Personal data in whole texts: fixed patterns, and spans that a character tagger adds.

The tagger (`char_tagger`) learns from windows around digits and `@` of a bounded sample of documents,
labelled with the spans of the patterns, and from rewritten copies of these spans that the patterns
miss, as many of each kind. Every kind holds digits or an `@`, so a text is read within REACH characters
of those and on to the end of a word that begins there; all such stretches of every text are tagged. A tagged span is added if it has what its kind needs and overlaps
neither a span of the patterns nor a match of its own kind that failed their check with as many digits.
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from storkline.llm import char_tagger, text
from storkline.llm.char_tagger import WINDOW

KINDS = ("email", "ip", "card", "phone")
#: bounds of what the tagger learns from: documents, half of them with spans, the first in an order by a hash;
#: characters of such a document; stretches of each; rewritten spans of each kind
SAMPLE, LONGEST, STRETCHES, REWRITTEN = 500, 20_000, 8, 250
EPOCHS = 14
TAGS = 2 * len(KINDS) + 1
#: characters read on both sides of a digit or `@`
REACH = 32

Span = tuple[int, int, int]  # start, end, index of the kind

_TRIGGER = re.compile(r"[0-9@]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL_BYTES = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if i % 2 == 0 else sum(divmod(2 * v, 10)) for i, v in enumerate(values)) % 10 == 0


def _emails(t: str) -> Iterator[tuple[int, int]]:
    """The text before an `@` is read backwards, so that a long run of letters costs its length."""
    end, at = 0, t.find("@")
    while at >= 0:
        begin = at
        while begin > end and t[begin - 1] in _LOCAL_BYTES:
            begin -= 1
        m = _DOMAIN.match(t, at + 1) if begin < at else None
        if m:
            end = m.end()
            yield begin, end
        at = t.find("@", max(at + 1, end))


def by_patterns(t: str) -> tuple[list[Span], list[Span]]:
    """Spans of the patterns, and matches that their checks reject."""
    good: list[Span] = [(a, b, 0) for a, b in _emails(t)]
    failed: list[Span] = []
    checks = (
        (1, _IP, lambda s: all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in s.split("."))),
        (2, _CARD, lambda s: 12 <= len(_digits(s)) <= 19 and luhn(_digits(s))),
        (3, _PHONE, lambda s: 9 <= len(_digits(s)) <= 15),
    )
    for kind, pattern, check in checks:
        for m in pattern.finditer(t):
            (good if check(m[0]) else failed).append((*m.span(), kind))
    return sorted(good, key=lambda s: (s[0], s[2])), failed


def stretches(t: str) -> list[tuple[int, int]]:
    """The parts of a text within REACH characters of a digit or `@`, with the words that reach over their edges."""
    found: list[list[int]] = []
    for m in _TRIGGER.finditer(t):
        if found and m.end() + REACH <= found[-1][1]:
            continue
        a, b = max(0, m.start() - REACH), min(len(t), m.end() + REACH)
        least = found[-1][1] if found else 0
        while a > least and not t[a - 1].isspace():
            a -= 1
        while b < len(t) and not t[b].isspace():
            b += 1
        if found and a <= found[-1][1]:
            found[-1][1] = b
        else:
            found.append([a, b])
    return [(a, b) for a, b in found]


def _tags(length: int, spans: Iterable[Span], begin: int) -> np.ndarray:
    """0 outside, 2 * kind + 1 at the first character of a span, 2 * kind + 2 at the others."""
    tags = np.zeros(length, np.int64)
    for a, b, kind in spans:
        a, b = a - begin, b - begin
        if a < length and b > 0:
            tags[max(a, 0):min(b, length)] = 2 * kind + 2
            if a >= 0:
                tags[a] = 2 * kind + 1
    return tags


def _spans(tags: np.ndarray, begin: int) -> list[Span]:
    found: list[Span] = []
    at = 0
    for i in np.flatnonzero(tags).tolist():
        if i < at:
            continue
        kind = (tags[i] - 1) // 2
        at = i + 1
        while at < len(tags) and tags[at] == 2 * kind + 2:
            at += 1
        found.append((begin + i, begin + at, int(kind)))
    return found


def _has_parts(s: str, kind: int) -> bool:
    """Whether a tagged span has what its kind needs."""
    n = len(_digits(s))
    if kind == 0:  # blanks may stand around the mark
        return bool(re.fullmatch(r"[^\s@]+\s{0,2}@\s{0,2}[^\s@]*\w\.\w[^\s@]*", s))
    if kind == 1:
        return len(re.findall(r"[0-9]+", s)) == 4 and len(s) <= 20
    return 12 <= n <= 19 and luhn(_digits(s)) if kind == 2 else 9 <= n <= 15


def _rewritten(s: str, kind: int, pick: random.Random) -> str:
    """The span in a form that the patterns may miss."""
    if kind == 2:
        d = _digits(s)
        return pick.choice(".·/").join(d[i:i + 4] for i in range(0, len(d), 4))
    if kind == 3:
        return pick.choice([s.lstrip("+"), s.lstrip("+").replace(" ", "."), "00" + s[1:], s.replace(" ", "/")])
    return s.replace(".", pick.choice(["·", " . "])) if kind == 1 else s.replace("@", pick.choice([" @ ", "@ "]))


def fit(texts: list[str], seed: int = 1) -> dict[str, np.ndarray]:
    """A tagger trained on the windows of these texts. Without any stretch it tags nothing."""
    pick = random.Random(seed)
    codes, tags = [], []

    def add(t: str, spans: list[Span], a: int, b: int) -> None:
        for w in char_tagger.window_starts(b - a):
            own = char_tagger.encode(t[a + w:min(a + w + WINDOW, b)])
            codes.append(np.pad(own, (0, WINDOW - len(own)), constant_values=char_tagger.PAD))
            tags.append(np.pad(_tags(len(own), spans, a + w), (0, WINDOW - len(own))))

    held: list[list[tuple]] = [[] for _ in KINDS]
    for t in texts:
        spans, _ = by_patterns(t)
        for a, b in stretches(t)[:STRETCHES]:
            # windows at chance places, so that a span may stand anywhere in one
            add(t, spans, max(0, a - pick.randrange(REACH)), b)
            inner = [s for s in spans if a <= s[0] and s[1] <= b]
            for x, y, kind in inner:
                held[kind].append((t, a, b, x, y, [s for s in inner if s[1] <= x or s[0] >= y]))
    for kind, own in enumerate(held):
        for t, a, b, x, y, others in (pick.choice(own) for _ in range(REWRITTEN if own else 0)):
            new = _rewritten(t[x:y], kind, pick)
            shift = len(new) - (y - x)
            moved = [(s + shift * (s >= y), e + shift * (e >= y), k) for s, e, k in others]
            # of a long stretch only the surroundings
            low, high = max(a, x - REACH), min(b, y + REACH) + shift
            add(t[:x] + new + t[y:], [*moved, (x, x + len(new), kind)], max(0, low - pick.randrange(REACH)), high)
    if not codes:
        return char_tagger.silent(TAGS)
    return char_tagger.train(np.array(codes), np.array(tags), TAGS, EPOCHS, seed=seed)


def _covers(t: str, begin: int, end: int, span: Span) -> bool:
    """Whether a stretch overlaps a span and holds as many digits: then it is the number that the span stands for."""
    a, b, _ = span
    return a < end and begin < b and len(_digits(t[begin:end])) >= len(_digits(t[a:b]))


def find(texts: list[str], model: dict[str, np.ndarray]) -> list[tuple[list[Span], list[Span]]]:
    """For each text the spans of the patterns and the spans added."""
    base = [by_patterns(t) for t in texts]
    places = [(i, a, b) for i, t in enumerate(texts) for a, b in stretches(t)]
    tagged = char_tagger.tag(model, [char_tagger.encode(texts[i][a:b]) for i, a, b in places]) if places else []
    added: list[list[Span]] = [[] for _ in texts]
    for (i, a, _), tags in zip(places, tagged, strict=True):
        found = [s for s in _spans(tags, a) if _has_parts(texts[i][s[0]:s[1]], s[2])]
        if found:
            good, failed = base[i]
            near = [(x, y) for x, y, _ in good if y > a], [(x, y, k) for x, y, k in failed if y > a]
            added[i] += [
                s for s in found
                if not any(s[0] < y and x < s[1] for x, y in near[0]) and not any(k == s[2] and _covers(texts[i], x, y, s) for x, y, k in near[1])
            ]
    return [(good, extra) for (good, _), extra in zip(base, added, strict=True)]


def _listed(spans: Iterable[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def _with_triggers(column: pa.Array) -> np.ndarray:
    """Which texts hold a digit or `@`; no other can hold a span."""
    data, offsets = text.raw(column)
    sums = np.concatenate([[0], np.cumsum(((data >= 48) & (data <= 57)) | (data == 64))])
    return np.flatnonzero(sums[offsets[1:]] > sums[offsets[:-1]])


_NOTHING = hashlib.sha256(b"").hexdigest()


def _report(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.chunks(batches):
            column = batch.column("text")
            rows = _with_triggers(column)
            counts = np.zeros((batch.num_rows, len(KINDS)), np.int64)
            digest, listed = [_NOTHING] * batch.num_rows, [""] * batch.num_rows
            added = np.zeros(batch.num_rows, np.int64)
            for i, (base, extra) in zip(rows.tolist(), find(column.take(pa.array(rows)).to_pylist(), model.value), strict=True):
                digest[i] = hashlib.sha256(_listed(base).encode()).hexdigest()
                listed[i] = _listed([*base, *extra])
                added[i] = len(extra)
                for *_, kind in (*base, *extra):
                    counts[i, kind] += 1
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(counts[:, k]) for k in range(len(KINDS))), pa.array(digest), pa.array(listed), pa.array(added)],
                ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added"],
            )
    return run


def learn(docs: DataFrame, sample: int = SAMPLE) -> dict[str, np.ndarray]:
    """A tagger from at most `sample` documents of fewer than LONGEST characters with digits or `@`, half of them
    with a likely span; of each the first STRETCHES stretches, and REWRITTEN rewritten spans of each kind in all."""
    plain = docs.select(F.col("text").cast("string").alias("text")).filter(F.col("text").rlike("[0-9@]")).filter(F.length("text") < LONGEST)
    likely = F.col("text").rlike(r"@|[0-9]{12}|[0-9]+\.[0-9]+\.[0-9]|\+[0-9]")
    rows: list[str] = []
    for part in (plain.filter(likely), plain.filter(~likely)):
        hashed = part.withColumn("hash", F.xxhash64("text"))
        first = hashed.select("hash").distinct().orderBy("hash").limit(sample // 2)
        last = first.agg(F.max("hash")).first()[0]  # texts travel only once the hashes are chosen
        if last is not None:
            chosen = hashed.filter(F.col("hash") <= last).select("hash", "text").distinct()
            rows += [r.text for r in sorted(chosen.collect(), key=lambda r: (r.hash, r.text))]
    model = fit(rows)
    text.let_go()  # the driver learns
    return model


def report(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of `docs`: `doc_id`; `n_email`, `n_ip`, `n_card`, `n_phone` (all spans);
    `base_sha256` of the spans of the patterns as `kind:start:end`, by start and kind; `spans`, all
    spans in that form; `n_added`, those that the tagger added. Offsets count code points.

    A null or empty text has no spans and the digest of the empty string. Rows are reported one by
    one, with or without doc_id, repeated or not; other columns are ignored.
    """
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return plain.mapInArrow(_report(model), f"doc_id long, {counts}, base_sha256 string, spans string, n_added long")


def masked(t: str, spans: Iterable[Span]) -> str:
    """The text with each span replaced by its kind; of spans that overlap the first names the kind."""
    out, at = [], 0
    for a, b, kind in sorted(spans, key=lambda s: (s[0], -s[1])):
        if a >= at:
            out += [t[at:a], f"<{KINDS[kind].upper()}>"]
        at = max(at, b)
    return "".join([*out, t[at:]])


def _mask(model):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text.chunks(batches):
            column = batch.column("text")
            rows = _with_triggers(column)
            whole = column.take(pa.array(rows)).to_pylist()
            spans = zip(rows.tolist(), whole, find(whole, model.value), strict=True)
            new = {i: masked(t, [*base, *extra]) for i, t, (base, extra) in spans if base or extra}
            if new:
                changed = {"text": pa.array([new.get(i, t) for i, t in enumerate(column.to_pylist())], column.type)}
                if "n_chars" in batch.schema.names:
                    sizes = batch.column("n_chars")
                    changed["n_chars"] = pa.array([len(new[i]) if i in new and n is not None else n for i, n in enumerate(sizes.to_pylist())], sizes.type)
                for name, values in changed.items():
                    at = batch.schema.get_field_index(name)
                    batch = batch.set_column(at, batch.schema.field(at), values)
            yield batch
    return run


def mask(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of `docs` with the spans in `text` replaced by `<KIND>`; `n_chars`, where present,
    follows the new text. Everything else stays, rows without spans as they are."""
    model = docs.sparkSession.sparkContext.broadcast(learn(docs, sample))
    return docs.mapInArrow(_mask(model), docs.schema)
