"""Secret scan by token efficiency.

Random strings are incompressible: a byte-pair vocabulary needs far more tokens for them than for words. A candidate run
of 16 or more key characters is reported when it has fewer than `LOOSE` characters for each token, holds letters and
digits, and is neither a known digest nor an identifier. Words around a secret do not hide it: what is not reported whole is
tested by its parts between signs, and by all windows of `LEAST` characters at `STRICT`; a span then goes to the next sign on
both sides, without plain words at its ends. Parts of letters alone are tested at `STRICT`, their windows at `STRICTER`. Three
fixed patterns (assignments, access keys, hex runs) are reported beside it.

Defined cases: null and empty texts have no spans; whole texts are scanned at any length; repeated rows are scanned alike;
an empty table gives an empty table; other columns are kept, and a result replaces a column of the same name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from gleanery.llm.frames import give_back, schema_with, small

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
#: Possible keys: long runs of base64 characters.
RUN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}")
#: Hex digits of MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512: known digests.
DIGESTS = (32, 40, 56, 64, 96, 128)
UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
#: Words or numbers joined by one kind of sign: file paths, slugs, constants, dates, phone and card numbers.
JOINED = re.compile(r"[A-Za-z]*[0-9]*([/_+-]([A-Za-z]+[0-9]{0,4}|[0-9]{1,8}))+")
#: Characters a token below which a run counts as random. Plain words have over 4, random base64 under 1.6.
LOOSE = 2.2
#: The same for windows and parts of letters alone, and for windows of letters alone, and characters of a window.
STRICT, STRICTER, LEAST = 1.6, 1.4, 16
PART = re.compile(r"[^/_+-]+")
#: Digests and UUIDs that stand between signs: no part of a secret.
KNOWN = re.compile(rf"(?<![^/_+-])(?:{UUID.pattern}|{'|'.join(f'[0-9a-f]{{{n}}}|[0-9A-F]{{{n}}}' for n in DIGESTS)})(?![^/_+=-])")


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a tiktoken vocabulary file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def is_identifier(run: str) -> bool:
    """Known digests, UUIDs, plain numbers, plain words and their joints are no secrets by themselves."""
    if len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    letters = sum(map(str.isalpha, run))
    digits = sum(map(str.isdigit, run))
    return not letters or not digits or UUID.fullmatch(run) is not None or JOINED.fullmatch(run) is not None


def _random(piece: str, count_tokens, loose: float, letters: float) -> bool:
    """Whether a piece of a run is random by itself; `letters` is the ratio for letters alone."""
    if piece.isalpha():
        return len(piece) < letters * count_tokens(piece)
    return not is_identifier(piece) and len(piece) < loose * count_tokens(piece)


def hidden(run: str, count_tokens, loose: float = LOOSE) -> list[tuple[int, int]]:
    """Spans of a run that are random although the run as a whole is not."""
    strict, stricter = loose * STRICT / LOOSE, loose * STRICTER / LOOSE
    out: list[tuple[int, int]] = []
    known = [m.span() for m in KNOWN.finditer(run)]
    for low, high in zip([0, *(e for _, e in known)], [*(s for s, _ in known), len(run)], strict=True):
        parts = [(low + m.start(), low + m.end()) for m in PART.finditer(run[low:high])]
        found = [k for k, (a, b) in enumerate(parts) if b - a >= LEAST and _random(run[a:b], count_tokens, loose, strict)]
        spans = [(k, k) for k in found]
        first, last = 0, 0
        for i in range(low, high - LEAST + 1):
            piece = run[i : i + LEAST].strip("/_+-")
            if piece and _random(piece, count_tokens, strict, stricter):
                while parts[first][1] <= i:
                    first += 1
                last = max(last, first)
                while last + 1 < len(parts) and parts[last + 1][0] < i + LEAST:
                    last += 1
                spans.append((first, last))
        # spans that share a part are one
        joined: list[list[int]] = []
        for a, b in sorted(spans):
            if joined and a <= joined[-1][1]:
                joined[-1][1] = max(joined[-1][1], b)
            else:
                joined.append([a, b])
        plain = lambda k: k not in found and is_identifier(run[slice(*parts[k])]) and parts[k][1] - parts[k][0] >= loose * count_tokens(run[slice(*parts[k])])
        for a, b in joined:
            while a < b and plain(a):
                a += 1
            while a < b and plain(b):
                b -= 1
            out.append((parts[a][0], parts[b][1]))
    return out


def scan(text: str | None, count_tokens, loose: float = LOOSE) -> list[tuple[int, int, int]]:
    """Spans of a whole text as (start, kind as its place in KINDS, end), sorted; code points, end exclusive."""
    if not text:
        return []
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in RUN.finditer(text):
        run = m[0]
        if not is_identifier(run) and len(run) < loose * count_tokens(run):
            found.append((m.start(), 3, m.end()))
        else:
            found += [(m.start() + a, 3, m.start() + b) for a, b in hidden(run, count_tokens, loose)]
    return sorted(found)


def _scanner(docs: DataFrame, vocabulary: str, pattern: str, loose: float) -> Callable[[], Callable[[str | None], list[tuple[int, int, int]]]]:
    """What makes a task's scan of a text. The vocabulary (a file of under 2 MB) is read by the driver and broadcast."""
    ranks = docs.sparkSession.sparkContext.broadcast(load_ranks(vocabulary))

    def make() -> Callable[[str | None], list[tuple[int, int, int]]]:
        import tiktoken

        give_back()
        tokens = tiktoken.Encoding("scan", pat_str=pattern, mergeable_ranks=ranks.value, special_tokens={})
        return lambda text: scan(text, lambda run: len(tokens.encode_ordinary(run)), loose)

    return make


def find_secrets(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", name: str = "secrets", loose: float = LOOSE) -> DataFrame:
    """`docs` with an array of structs (kind, start, end) of every span in `text`, by start and then by kind. One narrow pass without a shuffle."""
    docs = docs.drop(name)
    make = _scanner(docs, vocabulary, pattern, loose)
    schema = schema_with(docs, **{name: "array<struct<kind:string,start:int,end:int>>"})
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = make()
        for b in small(batches, at):
            out = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans(t.as_py())] for t in b.column(at)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, kind)], [*b.schema.names, name])

    return docs.mapInArrow(run, schema)


def cut(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    """`text` with every span (start, kind, end) replaced by `mark`, overlapping ones by one."""
    out, at = [], 0
    for start, end in sorted((s, e) for s, _, e in spans):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, vocabulary: str, pattern: str, text: str = "text", mark: str = "[SECRET]", loose: float = LOOSE) -> DataFrame:
    """`docs` with every secret in `text` replaced by `mark`; other texts pass as they are. One narrow pass, in one worker a task."""
    make = _scanner(docs, vocabulary, pattern, loose)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = make()
        for b in small(batches, at):
            columns = list(b.columns)
            texts = columns[at].to_pylist()
            found = [spans(t) for t in texts]
            if any(found):
                columns[at] = pa.array([cut(t, x, mark) if x else t for t, x in zip(texts, found, strict=True)], columns[at].type)
            yield pa.RecordBatch.from_arrays(columns, b.schema.names)

    return docs.mapInArrow(run, docs.schema)
