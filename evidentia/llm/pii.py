"""Personal data by weak supervision.

Base: email, ip, card and phone spans by fixed patterns, leftmost and non-overlapping within a kind; a match that fails its check
(parts over 255, Luhn, number of digits) is dropped. Base spans always stay.

The method adds spans. Looser patterns propose candidates that the base does not cover: spelled-out mail addresses,
phone numbers without a plus, card numbers that the base misses (13 digits, or inside a longer run), IPv6-like groups, names after a
title or a cue, and secrets after a key word or with a known prefix. A card candidate must pass Luhn. Labelers vote on each candidate,
+1, -1 or abstain:

* regex labelers judge the candidate's form (digit counts, grouping, dates, domain endings);
* gazetteer labelers look for its parts in small lists (given names, mail providers, issuer digits, address and key prefixes);
* context labelers look at the words before and after it.

One pass reads the texts and writes each row's base spans and candidates, the latter with their votes and hashed features; no
text is read again. Expectation-maximisation over the counts of all vote patterns (at most 3^labelers a kind) estimates each
labeler's reliability, which may come out below chance. The posteriors are the labels of the final span classifier, a
logistic regression for each kind over hashed features of the span and its context: its shape, length, characters and words, and the
words beside it. It is fitted on at most EXAMPLES distinct candidates of a kind, drawn by a hash and weighted by their counts in the
whole corpus. A candidate that it accepts becomes a span.

Cases: a null text is the empty text; spans are code points, end exclusive; a text without candidates has only base spans; repeated
rows count as rows; an empty table gives an empty result. Overlaps: a candidate that overlaps a base span or an earlier accepted span
is left out. Runs of digits and keys of any length are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections.abc import Iterator, Mapping
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import materialize

#: The order of kinds in a digest.
KINDS = ("email", "ip", "card", "phone", "name", "secret")
BASE = KINDS[:4]

_MAIL_LEFT = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_domain = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_ip = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
_card = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_phone = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_not_digit = re.compile(r"[^0-9]")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of the mail pattern; linear in the text, as only the characters around each @ are read."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > done and text[begin - 1] in _MAIL_LEFT:
            begin -= 1
        m = _domain.match(text, at + 1) if begin < at else None
        if m:
            out.append((begin, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[Span]:
    out: list[Span] = [("email", *x) for x in emails(text)]
    if _has_digit(text):
        for m in _ip.finditer(text):
            if all(_octet(p) for p in m[0].split(".")):
                out.append(("ip", *m.span()))
        for m in _card.finditer(text):
            digits = _not_digit.sub("", m[0]) if m.end() - m.start() < 64 else ""
            if 14 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
        if "+" in text:
            for m in _phone.finditer(text):
                if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
                    out.append(("phone", *m.span()))
    return sorted(out, key=_order)


def _order(s: Span) -> tuple[int, int, int]:
    return s[1], KINDS.index(s[0]), s[2]


_digit = re.compile("[0-9]")


def _has_digit(text: str) -> bool:
    return _digit.search(text) is not None


# --- candidates -----------------------------------------------------------------------------------------------------------------

#: Gazetteers by name: small lists of this engine, which a caller may replace by larger ones.
GAZETTEERS: dict[str, frozenset[str]] = {
    "given": frozenset(
        """alice anders andrea andrew anita anna anne antonio barbara beatriz ben bernd bruno camille carla carlos carmen caroline charles charlotte chloe christian christine claire clara
claudia daniel david diego elena eleanor elisabeth emily emma erik eva felix fernando francesca francisco frank franz george gabriel hannah hans heidi helen helena henri henry ines ingrid isabel
ivan jack jacques james jan jane javier jean jennifer jens john jonas jorge jose josef julia julie juliette jurgen karen karin karl katharina kevin klaus laura lea lena linda louis louise lucas
lucia luis lukas manuel marc marco margaret maria marie mario mark markus marta martin mary matthias max michael miguel monica nathalie nicolas nina olivia oscar pablo patricia patrick paul
pedro peter philipp pierre rachel rafael ralf richard robert rosa ruth sabine samuel sandra sara sarah sebastian silvia simon sofia sophie stefan stephanie susan susanne sven teresa thomas tim
tobias tom ursula victor victoria walter werner william wolfgang yves""".split()
    ),
    "titles": frozenset("mr mrs ms dr prof herr frau monsieur madame mme señor señora sr sra".split()),
    "providers": frozenset("gmail googlemail hotmail outlook live yahoo aol example mail icloud proton protonmail gmx web orange free laposte terra telefonica fastmail zoho".split()),
    "issuers": frozenset("34 36 37 38 39 30 35 4 51 52 53 54 55 22 23 24 25 26 27 60 62 64 65".split()),
    "address": frozenset("2001 2003 2400 2600 2604 2607 2620 2800 2a00 2a01 2a02 2a03 2c0f fd00 fe80 fc00 ff02".split()),
    "keys": frozenset("AKIA ASIA AIza ghp_ gho_ ghs_ glpat xoxb xoxp sk_live sk- pk_live eyJ SG. ya29 EAAC".split()),
}
CUES = {
    "email": frozenset("email mail e-mail contact address adresse correo courriel write".split()),
    "ip": frozenset("ip host server address ipv6 dns gateway router subnet".split()),
    "card": frozenset("card visa mastercard amex credit debit karte carte tarjeta kreditkarte".split()),
    "phone": frozenset("phone tel telephone call mobile fax cell telefon téléphone teléfono handy number".split()),
    "name": frozenset("name named signed author contact by from regards sincerely nom nombre dear".split()),
    "secret": frozenset("token secret password passwd key api apikey pwd credential bearer auth authorization".split()),
}
_NAME = r"[A-ZÀ-Þ][a-zß-ÿ]{1,30}"
_LOOSE = {
    "email": re.compile(r"\b[A-Za-z0-9._%+-]{1,64}\s?(?:\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9-]{1,63}(?:\s?(?:\(dot\)|\[dot\]|\sdot\s|\.)\s?[A-Za-z0-9-]{2,63}){1,4}\b"),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9]{4}(?:[ .-]?[0-9]{4}){2,3}(?:[ .-]?[0-9]{1,3})?(?![0-9])"),
    "phone": re.compile(r"(?<![0-9.+(])(?:\+[0-9]{1,3}[ .-])?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{2,4}[ .-][0-9]{3,6}(?![0-9.])"),
    "name": re.compile(
        rf"\b(?:(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Madame|Monsieur|Señor|Señora)\b\.? ()|(?:[Nn]ame|[Cc]ontact|[Aa]uthor|[Ss]igned|[Rr]egards|[Ss]incerely|[Nn]om|[Nn]ombre)(?: is|:|,) ?\n?)({_NAME}(?: {_NAME}){{0,2}})"
    ),
    "secret": re.compile(
        r"(?:\b(?:[Tt]oken|TOKEN|[Ss]ecret|SECRET|[Pp]assword|PASSWORD|passwd|[Aa]pi[_-]?[Kk]ey|API_KEY|pwd)\b\s{0,3}[:=]\s{0,3}[\"']?|\b[Bb]earer |\b(?=(?:AKIA|ASIA|AIza|gh[pos]_|glpat-|xox[bp]-|sk_live|eyJ)[A-Za-z0-9]))([A-Za-z0-9+/_=-]{8,}+)"
    ),
}
#: Substrings of which a text must have one to hold a candidate of the kind at all; finding them is far cheaper than a pattern.
_MAY = {
    "email": ("(at)", "[at]", " at "),
    "ip": (":",),
    "card": ("",),
    "phone": ("",),
    "name": ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Madame", "Monsieur", "Señor", *(f"{cue}{end}" for cue in ("ame", "ontact", "uthor", "igned", "egards", "incerely", "om", "ombre") for end in (":", ",", " is"))),
    "secret": ("oken", "TOKEN", "ecret", "SECRET", "assw", "PASSW", "api", "Api", "API", "pwd", "earer", "AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghs_", "glpat-", "xox", "sk_live", "eyJ"),
}
#: What every candidate of the kind holds; these patterns begin with a set of characters, so they are looked for much faster.
_HOLDS = {
    "email": re.compile(r"[(\[\s]at[)\]\s]\s?[A-Za-z0-9-]{1,63}\s?(?:[(\[]dot[)\]]|\sdot\s|\.)\s?[A-Za-z0-9-]{2}"),
    "ip": re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{1,4}:[0-9A-Fa-f]"),
    "card": re.compile(r"[0-9]{4}[ .-]?[0-9]{4}[ .-]?[0-9]{4}"),
    "phone": re.compile(r"[0-9]{2}\)?[ .-][0-9]{2,4}[ .-][0-9]{3}"),
}
_word = re.compile(r"[^\W\d_]+")
_date = re.compile(r"\(?(?:[0-3]?[0-9][ .-][0-3]?[0-9][ .-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}[ .-].*)")
NEAR = 40


def _span_of(kind: str, m: re.Match) -> tuple[int, int]:
    if kind == "secret":
        return m.span(1)
    if kind == "name" and m[1] is None:  # after a cue, the name alone; a title belongs to the name
        return m.span(2)
    return m.span()


def candidates(text: str, base: list[Span]) -> list[Span]:
    """Loose matches that no base span overlaps, by start. Cards pass Luhn."""
    out: list[Span] = []
    digits = _has_digit(text)
    for kind, loose in _LOOSE.items():
        if kind in ("card", "phone") and not digits or not any(x in text for x in _MAY[kind]):
            continue
        if kind in _HOLDS and not _HOLDS[kind].search(text):
            continue
        for m in loose.finditer(text):
            if kind == "card" and not (13 <= len(d := _not_digit.sub("", m[0])) <= 19 and luhn(d)):
                continue
            out.append((kind, *_span_of(kind, m)))
    if not out:
        return out
    starts, ends = _merged(base)

    def free(s: Span) -> bool:
        i = bisect_left(starts, s[2]) - 1  # of the ranges that begin before its end, the last ends last
        return i < 0 or ends[i] <= s[1]

    return sorted(filter(free, out), key=_order)


def _merged(spans: list[Span]) -> tuple[list[int], list[int]]:
    """The ranges that the spans, by start, cover together; they do not overlap."""
    starts: list[int] = []
    ends: list[int] = []
    for _, b, e in spans:
        if ends and b < ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            starts.append(b)
            ends.append(e)
    return starts, ends


LABELERS = ("form", "strict_form", "gazetteer", "cue_before", "cue_near", "plain_context")


def _sign(yes: bool) -> int:
    return 1 if yes else -1


def votes(text: str, span: Span, lists: Mapping[str, frozenset[str]] = GAZETTEERS) -> tuple[int, ...]:
    """One vote of +1, -1 or 0 (abstain) for each labeler."""
    kind, begin, end = span
    body = text[begin:end]
    before, after = text[max(0, begin - NEAR) : begin], text[end : end + NEAR]
    words = [w.lower() for w in _word.findall(body[:200])]
    near = [w.lower() for w in _word.findall(before)]
    gazetteer = 0
    if kind == "email":
        form = _sign("(at)" in body or "[at]" in body)
        strict = _sign(bool(words) and words[-1] in ("com", "org", "net", "edu", "gov", "info", "de", "fr", "es", "io", "uk", "eu", "ch", "at"))
        gazetteer = int(not lists["providers"].isdisjoint(words))
    elif kind == "ip":
        form = _sign(body.count(":") == 7)
        strict = _sign(any(c in "abcdefABCDEF" for c in body) and _has_digit(body))
        gazetteer = int(body.split(":")[0].lower() in lists["address"])
    elif kind == "card":
        digits = _not_digit.sub("", body)
        form = _sign(len(digits) in (13, 15, 16))
        strict = _sign(len({len(g) for g in re.split("[ .-]", body)}) == 1)
        gazetteer = _sign(any(digits.startswith(x) for x in lists["issuers"]))
    elif kind == "phone":
        form = _sign(9 <= len(_not_digit.sub("", body)) <= 11)
        strict = -1 if _date.fullmatch(body) else int("(" in body)
        gazetteer = int(body.startswith("0"))
    elif kind == "name":
        form = int(len(words) >= 2)
        strict = _sign(bool(words) and words[0] in lists["titles"] or ":" in before[-3:])
        gazetteer = int(not lists["given"].isdisjoint(words))
    else:
        form = _sign(len(body) >= 16)
        strict = _sign(_has_digit(body) and _word.search(body) is not None)
        gazetteer = int(any(body.startswith(x) for x in lists["keys"]))
    led = kind == "secret" or kind == "name" and not (words and words[0] in lists["titles"])  # a cue proposed it, and is no second witness
    cue = int(not led and not CUES[kind].isdisjoint(near[-3:]))
    close = int(not CUES[kind].isdisjoint(near[:-2] if led else near) or not CUES[kind].isdisjoint(w.lower() for w in _word.findall(after)))
    plain = -1 if re.search(r"[0-9]\s*$", before) or re.match(r"\s*[0-9%€$]", after) else 0
    return form, strict, gazetteer, cue, close, plain


#: Hashed features of a candidate.
FEATURES = 1 << 12
_SHAPE = str.maketrans({**{c: "0" for c in "0123456789"}, **{c: "a" for c in "abcdefghijklmnopqrstuvwxyz"}, **{c: "A" for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}})
_runs = re.compile(r"(.)\1+", re.S)


def features(text: str, span: Span) -> list[int]:
    """What the classifier sees of a span and its context, as distinct numbers below FEATURES."""
    kind, begin, end = span
    body = text[begin:end]
    head = body[:64]
    shape = head.translate(_SHAPE)
    short = _runs.sub(r"\1+", shape)
    before, after = text[max(0, begin - NEAR) : begin], text[end : end + NEAR]
    near, then = _word.findall(before.lower()), _word.findall(after.lower())
    seen = ["bias", f"shape {short[:24]}", f"ends {short[:2]} {short[-2:]}", f"length {min(64, end - begin) // 4}", f"begin {head[:2]}"]
    seen += [f"has {c}" for c in "0aA-_.:+/=() " if c in shape]
    seen += [f"distinct {len(set(head)) // 4}", f"left {before[-1:].translate(_SHAPE)}", f"right {after[:1].translate(_SHAPE)}"]
    seen += [f"word {w.lower()}" for w in _word.findall(head)[:4]]
    seen += [f"before {w}" for w in near[-4:]] + [f"last {near[-1] if near else ''}", f"next {then[0] if then else ''}"] + [f"after {w}" for w in then[:3]]
    return sorted({crc32(f"{kind} {x}".encode()) % FEATURES for x in seen})


# --- models ---------------------------------------------------------------------------------------------------------------------

#: Distinct candidates of a kind that the classifier is fitted on at most.
EXAMPLES = 20_000


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labels:
    """Reliabilities of the labelers of a kind, by EM over vote patterns and their counts."""

    def __init__(self, counts: Mapping[tuple[int, ...], int], rounds: int = 50):
        v = np.array(list(counts), float).reshape(len(counts), -1)
        n = np.array(list(counts.values()), float)
        self.prior, self.right = 0.5, np.full(v.shape[1], 0.8)
        for _ in range(rounds):
            post = self.posterior(v)
            agree = (v > 0) * post[:, None] + (v < 0) * (1 - post[:, None])
            cast = (v != 0) * n[:, None]
            self.right = ((agree * n[:, None]).sum(axis=0) + 8) / (cast.sum(axis=0) + 10)  # a labeler that never votes stays at 0.8
            self.right = np.clip(self.right, 0.02, 0.98)
            self.prior = float(np.clip((post @ n + 5) / (n.sum() + 10), 0.05, 0.95))

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """The probability that a candidate with these votes is personal data."""
        return _sigmoid(math.log(self.prior / (1 - self.prior)) + v @ np.log(self.right / (1 - self.right)))


class Classifier:
    """Logistic regression over hashed features, by full gradients with steps of their own for each weight."""

    def __init__(self, rows: list[list[int]], label: np.ndarray, n: np.ndarray, steps: int = 200):
        self.w = np.zeros(FEATURES, np.float32)
        at = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        col = np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
        w, seen = np.zeros(FEATURES), np.full(FEATURES, 1e-8)
        share = n / max(1.0, float(n.sum()))
        for _ in range(steps):
            p = _sigmoid(np.bincount(at, w[col], len(rows)))
            g = np.bincount(col, (share * (p - label))[at], FEATURES) + 1e-5 * w
            seen += g * g
            w -= 0.5 * g / np.sqrt(seen)
        self.w = w.astype(np.float32)

    def score(self, row: list[int]) -> float:
        return float(_sigmoid(np.float64(self.w[row].sum())))


class SpanModel:
    def __init__(self, counts: Mapping[tuple[str, tuple[int, ...]], int], examples: list[tuple[str, tuple[int, ...], list[int], int]]):
        """counts: of (kind, votes) in the whole corpus; examples: kind, votes, features, count."""
        self.labels: dict[str, Labels] = {}
        self.classifier: dict[str, Classifier] = {}
        for kind in KINDS:
            own = {v: n for (k, v), n in sorted(counts.items()) if k == kind}
            if not own:
                continue
            self.labels[kind] = Labels(own)
            rows = [(v, f, n) for k, v, f, n in examples if k == kind]
            post = self.labels[kind].posterior(np.array([v for v, _, _ in rows], float).reshape(len(rows), -1))
            self.classifier[kind] = Classifier([f for _, f, _ in rows], post, np.array([n for _, _, n in rows], float))

    def accepts(self, kind: str, row: list[int]) -> bool:
        return kind in self.classifier and self.classifier[kind].score(row) >= 0.5


SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
FOUND = "array<struct<kind:string,start:int,end:int,votes:array<int>,features:array<int>>>"
_FOUND = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("votes", pa.list_(pa.int32())), ("features", pa.list_(pa.int32()))]))


def _span_column(rows: list[list[Span]]) -> pa.Array:
    return pa.array([[{"kind": k, "start": s, "end": e} for k, s, e in r] for r in rows], _SPANS)


def scan(docs: DataFrame, lists: Mapping[str, frozenset[str]] = GAZETTEERS) -> DataFrame:
    """doc_id, base, found (candidates with votes and features) for each row of docs: the one pass over the texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base, found = [], []
            for text in b.column("text").to_pylist():
                own = base_spans(text) if text else []
                base.append(own)
                found.append([{"kind": s[0], "start": s[1], "end": s[2], "votes": votes(text, s, lists), "features": features(text, s)} for s in candidates(text, own)] if text else [])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), _span_column(base), pa.array(found, _FOUND)], ["doc_id", "base", "found"])

    d = docs.select("doc_id", "text")
    return d.mapInArrow(run, f"doc_id {d.schema['doc_id'].dataType.simpleString()}, base {SPAN}, found {FOUND}")


def fit(scanned: DataFrame, examples: int = EXAMPLES) -> SpanModel:
    """Counts of vote patterns over the whole table, and a bounded draw of distinct candidates; the driver holds no more."""
    spark = scanned.sparkSession
    rows = scanned.where(F.size("found") > 0).select(F.explode("found").alias("c")).select("c.kind", "c.votes", "c.features")
    rows = materialize(rows.groupBy("kind", "votes", "features").agg(F.count(F.lit(1)).alias("n")), "pii-examples")
    table = rows.groupBy("kind", "votes").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("rows")).collect()  # 3^labelers a kind at most
    if not table:
        return SpanModel({}, [])
    distinct: dict[str, int] = {}
    for r in table:
        distinct[r.kind] = distinct.get(r.kind, 0) + r.rows
    share = spark.createDataFrame([(k, min(1.0, 1.2 * examples / n)) for k, n in distinct.items()], "kind string, share double")
    rank = F.pmod(F.xxhash64(F.lit(3), "kind", "votes", "features"), F.lit(1 << 30)) / float(1 << 30)
    drawn = rows.withColumn("rank", rank).join(F.broadcast(share), "kind").where("rank < share").collect()  # about 1.2 x examples a kind, each a distinct candidate
    taken: dict[str, int] = {}
    use = []
    for r in sorted(drawn, key=lambda r: (r.rank, r.kind, r.votes, r.features)):
        taken[r.kind] = taken.get(r.kind, 0) + 1
        if taken[r.kind] <= examples:
            use.append((r.kind, tuple(r.votes), r.features, r.n))
    return SpanModel({(r.kind, tuple(r.votes)): r.n for r in table}, use)


def added(base: list[Span], found: list[dict], model: SpanModel) -> list[Span]:
    """Base spans and the accepted candidates, by start and kind; of overlapping candidates the first."""
    out, done = list(base), 0
    for c in found:
        if c["start"] >= done and model.accepts(c["kind"], c["features"]):
            out.append((c["kind"], c["start"], c["end"]))
            done = c["end"]
    return sorted(out, key=_order)


def find_pii(docs: DataFrame, model: SpanModel | None = None, lists: Mapping[str, frozenset[str]] = GAZETTEERS) -> DataFrame:
    """doc_id, base, spans (arrays of kind, start, end) for each row of docs."""
    scanned = materialize(scan(docs, lists), "pii-found")
    model = model or fit(scanned)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            base = [[(s["kind"], s["start"], s["end"]) for s in r] for r in b.column("base").to_pylist()]
            spans = [added(own, found, model) for own, found in zip(base, b.column("found").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("base"), _span_column(spans)], ["doc_id", "base", "spans"])

    return scanned.mapInArrow(run, f"doc_id {scanned.schema['doc_id'].dataType.simpleString()}, base {SPAN}, spans {SPAN}")


def joined(col: str):
    return F.array_join(F.transform(col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def query(spark, sf_dir: str) -> DataFrame:
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"), F.size("spans").cast("long").alias("n_spans"))
