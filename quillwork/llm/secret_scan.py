"""Secret scan: pattern candidates, then a random forest that removes false positives.

Candidates are private-key blocks, values assigned to a name, and runs of at least ``LEAST`` token characters with a
digit.  The forest judges each by its length, its character transitions, how much of it dictionary words cover, path
marks in it and in the row's path, and the words beside it.  It is trained from labelled findings; without a table of
them, from seeded ones that ``example_findings`` writes (``FINDINGS`` rows, the documented bound).  Every whole text is
scanned; rows do not depend on each other, so there is no shuffle.

Defined cases: null or empty text has no candidate; repeated rows repeat their findings; overlapping candidates are
reported once, private-key blocks first, then assignments; a null path is an empty path; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.llm import common, forest

LEAST, FINDINGS, THRESHOLD = 16, 4000, 0.5
KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----.*?-----END [A-Z ]{0,40}PRIVATE KEY-----", re.S)
ASSIGNED = re.compile(r"\b([A-Za-z][A-Za-z0-9_\-]{1,40})[\"']?\s{0,3}(?:=>|:=|=|:)\s{0,3}[\"']?([A-Za-z0-9+/=_\-!@#$%^&*.~]{8,})")
RUN = re.compile(r"[A-Za-z0-9+/=_\-]{%d,}" % LEAST)
NAMES = ("token", "secret", "password", "passwd", "pwd", "apikey", "key", "auth", "credential", "bearer", "access", "private", "signature")
PLAIN = ("commit", "sha", "md5", "checksum", "hash", "digest", "uuid", "guid", "id", "version", "build", "isbn", "example", "test", "sample", "placeholder", "url", "file", "path", "image", "etag")
HIDDEN = ("test", "example", "sample", "doc", "fixture", "vendor", "mock")
DICTIONARY = frozenset(
    "the and for you not with this that from have are was will your can all has but one our out use new time name data file user type code value test"
    " example sample password secret token key here change default config service server client admin public private access account address image index"
    " content page link local main master first last next page path project release update version search table text title number order string system"
    " work world year come could day did get good how into just know like look make man more most other over people said see she some than their them"
    " then there these they thing think two want way well what when which who would write about after again before being between down each end even every"
    " find found give great group hand high home house keep large left life little long much must never old only part place point right same school set show"
    " small state still such take tell through under until very where while without word".split()
)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk_live_", "sk-", "xoxb-", "xoxp-", "AIza", "eyJ", "-----BEGIN")


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in (s.count(x) for x in set(s))) if n else 0.0


def coverage(s: str) -> float:
    """Share of the letters of ``s`` that greedy longest dictionary words (3 to 10 letters) cover."""
    low, at, hit = s.lower(), 0, 0
    letters = sum(c.isalpha() for c in low)
    while at < len(low) - 2:
        for n in range(min(10, len(low) - at), 2, -1):
            if low[at : at + n] in DICTIONARY:
                hit, at = hit + n, at + n
                break
        else:
            at += 1
    return hit / letters if letters else 0.0


def kind_of(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def describe(value: str, before: str, after: str, name: str, path: str) -> list[float]:
    """The forest's features of one candidate; a long value is described by its whole length."""
    kinds = [kind_of(c) for c in value]
    n = len(kinds)
    moves = np.zeros((4, 4))
    np.add.at(moves, (kinds[:-1], kinds[1:]), 1)
    moves /= max(1, n - 1)
    words = [w.lower() for w in re.findall(r"[A-Za-z0-9]+", before)[-3:]] + [w.lower() for w in re.findall(r"[A-Za-z0-9]+", after)[:3]]
    tag = name.lower().replace("_", "").replace("-", "")
    near = " ".join([*words, tag])
    low = path.lower()
    hexes = sum(c in "0123456789abcdefABCDEF" for c in value) / n
    vowels = sum(c in "aeiouAEIOU" for c in value) / max(1, sum(c.isalpha() for c in value))
    return [
        n, math.log2(n), entropy(value), len(set(value)) / n, hexes, vowels, coverage(value), *moves.ravel().tolist(), *(kinds.count(k) / n for k in range(4)),
        float(n in (32, 40, 64)), float(bool(re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", value))), max((len(m.group()) for m in re.finditer(r"(.)\1*", value, re.S)), default=0) / n,
        value.count("/"), value.count("-"), value.count("="), float(value.startswith(PREFIXES)), float(bool(name)), float(any(x in tag for x in NAMES)), float(any(x in tag for x in PLAIN)),
        sum(x in near for x in NAMES), sum(w in PLAIN for w in words), float(before.rstrip().endswith(("=", ":", '"', "'"))), sum(x in low for x in HIDDEN), low.count("/"),
    ]


def _added(found: list[tuple], more: list[tuple]) -> list[tuple]:
    """Both lists (each in text order) in one, without those of ``more`` that overlap one of ``found``."""
    keep, i = [], 0
    for x in more:
        while i < len(found) and found[i][1] <= x[0]:
            i += 1
        if i == len(found) or found[i][0] >= x[1]:
            keep.append(x)
    return sorted(found + keep)


def candidates(text: str) -> list[tuple[int, int, str, str]]:
    """(begin, end, kind, name) in text order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    if "PRIVATE KEY" in text:
        found += [(m.start(), m.end(), "key block", "") for m in KEY_BLOCK.finditer(text)]
    if "=" in text or ":" in text:
        named = [(*m.span(2), "assigned", m[1]) for m in ASSIGNED.finditer(text) if any(c.isdigit() for c in m[2]) or any(x in m[1].lower() for x in NAMES)]
        found = _added(found, named)
    found = _added(found, [(*m.span(), "run", "") for m in RUN.finditer(text) if any(c.isdigit() for c in m.group())])
    return found


def describe_in(text: str, begin: int, end: int, name: str, path: str) -> list[float]:
    return describe(text[begin:end], text[max(0, begin - 64) : begin], text[end : end + 48], name, path)


def example_findings(n: int = FINDINGS, seed: int = 23) -> list[tuple[str, int, int, str, str, int]]:
    """Seeded labelled findings: (text, begin, end, name, path, label)."""
    rng = random.Random(seed)
    pick = lambda alphabet, k: "".join(rng.choice(alphabet) for _ in range(k))
    word = lambda: pick("aeiounrtslchdm", rng.randint(2, 9))
    prose = lambda: " ".join(word() for _ in range(rng.randint(2, 6)))
    hexes, both = "0123456789abcdef", string.ascii_letters + string.digits
    made = []
    for k in range(n):
        label, shape = k % 2, rng.randrange(6)
        path = rng.choice(["src/main.py", "app/config.yml", "deploy/env.sh", "web/index.html", "src3", "src12", ""])
        name, value, how = "", "", rng.randrange(3)
        if label:
            value = [lambda: pick(hexes, rng.choice([32, 40, 40, 48, 64])), lambda: pick(both, rng.randint(20, 48)), lambda: pick(both + "+/", rng.choice([40, 44, 64])) + rng.choice(["", "="]), lambda: rng.choice(["AKIA", "ASIA"]) + pick(string.ascii_uppercase + string.digits, 16), lambda: rng.choice(["ghp_", "sk_live_", "xoxb-", "glpat-"]) + pick(both, 36), lambda: pick(both + "!@#$%^&*", rng.randint(10, 20))][shape]()
            name = rng.choice(["token", "api_key", "secret", "password", "auth_token", "access_key", "apiKey", "client_secret", "private_token", "Bearer"])
            if shape in (3, 4) and how == 2:
                name = ""
        else:
            value = [lambda: pick(hexes, rng.choice([32, 40, 64])), lambda: "-".join(pick(hexes, j) for j in (8, 4, 4, 4, 12)), lambda: pick("0123456789", rng.randint(16, 20)), lambda: "-".join([*rng.sample(sorted(DICTIONARY), rng.randint(2, 4)), pick("0123456789", 2)]), lambda: "/".join([word(), word(), word() + pick("0123456789", 3)]), lambda: rng.choice(["xxxxxxxxxxxxxxxx1", "your-token-here-1", "0000000000000000", "change-me-please-1", "123456789012345678", "EXAMPLE-TOKEN-0001", "test-password-123"])][shape]()
            name = rng.choice(["commit", "sha", "md5", "checksum", "uuid", "id", "etag", "version", "build", "file", "url", "digest"]) if shape in (0, 1, 2) or how else ""
            if shape == 5:
                name = rng.choice(["token", "password", "api_key", "secret"])
                path = rng.choice(["docs/example.md", "tests/fixtures/a.py", "sample/config.yml", path])
        lead = f"{name}{rng.choice([' = ', '=', ': '])}{rng.choice(['', chr(34), chr(39)])}" if name and how < 2 else f"{name} " if name else ""
        head = prose() + " " + lead
        text = head + value + rng.choice(['"', "'", " ", "\n"]) + " " + prose()
        made.append((text, len(head), len(head) + len(value), name if how < 2 else "", path, label))
    return made


def train(findings: list[tuple[str, int, int, str, str, int]] | None = None) -> forest.Forest:
    """The forest of labelled findings (text, begin, end, name, path, label)."""
    rows = example_findings() if findings is None else findings
    x = np.array([describe_in(t, a, b, name, path) for t, a, b, name, path, _ in rows])
    return forest.fit(x, np.array([r[-1] for r in rows], float))


def _judged(model: forest.Forest, texts: list[str], paths: list[str | None]) -> list[list[tuple[int, int, str, str, float]]]:
    found = [candidates(t) for t in texts]
    x = [describe_in(t, a, b, name, p or "") for t, p, own in zip(texts, paths, found) for a, b, _, name in own]
    s = iter(model.predict(np.array(x)).tolist() if x else [])
    return [[(a, b, kind, name, next(s)) for a, b, kind, name in own] for own in found]


def scan(docs: DataFrame, model: forest.Forest, key: str = "doc_id", text: str = "text", path: str | None = "source") -> DataFrame:
    """Every candidate: ``key, begin, end, kind, name, value_sha256, score, secret``; offsets count characters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = F.col(path).cast("string") if path else F.lit("")
    rows = docs.select(F.col(key).alias("key"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"), F.coalesce(at, F.lit("")).alias("path"))
    kind = rows.schema["key"].dataType.simpleString()
    schema = f"key {kind}, begin int, end int, kind string, name string, value_sha256 string, score double, secret boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches):
            texts, keys, out = b.column("text").to_pylist(), b.column("key"), []
            for i, own in enumerate(_judged(sent.value, texts, b.column("path").to_pylist())):
                out += [(i, a, z, kind, name, hashlib.sha256(texts[i][a:z].encode()).hexdigest(), s, s >= THRESHOLD) for a, z, kind, name, s in own]
            if out:
                i, *rest = zip(*out)
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(i)), *(pa.array(c, t) for c, t in zip(rest, kinds))], ["key", "begin", "end", "kind", "name", "value_sha256", "score", "secret"])

    return rows.mapInArrow(run, schema).withColumnRenamed("key", key)


def redact(docs: DataFrame, model: forest.Forest, text: str = "text", path: str | None = "source", mark: str = "[secret]", length: str | None = "n_chars") -> DataFrame:
    """``docs`` with each confirmed secret replaced by ``mark``; ``length`` (if a column) is set anew where text changed."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(names)))
    t, p = names.index(text), names.index(path) if path in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in common.blocks(batches, f"c{t}"):
            texts = b.column(t).to_pylist()
            paths = [None if x is None else str(x) for x in b.column(p).to_pylist()] if p is not None else [None] * len(texts)
            for i, own in enumerate(_judged(sent.value, [x or "" for x in texts], paths)):
                for a, z, _, _, s in reversed(own):
                    if s >= THRESHOLD:
                        texts[i] = texts[i][:a] + mark + texts[i][z:]
            yield b.set_column(t, f"c{t}", pa.array(texts, b.schema.field(t).type))

    out = rows.mapInArrow(run, rows.schema)
    if length in names:
        i = names.index(length)
        out = out.withColumn(f"c{i}", F.coalesce(F.length(f"c{t}").cast(rows.schema[i].dataType), F.col(f"c{i}")))
    return out.select(*(F.col(f"c{i}").alias(c) for i, c in enumerate(names)))
