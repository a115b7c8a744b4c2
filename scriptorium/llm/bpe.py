"""BPE encoding and decoding (operator 6).

Merges are applied from a priority queue of merge ranks over a doubly linked list of symbols; queue entries whose symbols
have changed meanwhile are stale and skipped. Decoding concatenates the vocabulary's strings.
"""

from __future__ import annotations

import json
import re
from array import array
from heapq import heapify, heappop, heappush

import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_python, table

#: The byte-level pattern for pre-tokens of the vocabulary's publisher.
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens kept with their ids in a worker: two tables of half as many, of which the older goes when the younger is full.
CACHED = 400_000


def _unlike_class() -> str:
    """Characters that the standard library's classes sort otherwise than the pattern, and all from U+0700 on but for general punctuation."""
    pairs = [(re.compile(a), regex.compile(b)) for a, b in ((r"[^\W\d_]", r"\p{L}"), (r"\d", r"\p{N}"), (r"\s", r"\p{White_Space}"), (r"\w", r"[\p{L}\p{N}_]"))]
    odd = [c for c in map(chr, [*range(0x700), *range(0x2000, 0x2070)]) if any(bool(a.match(c)) != bool(b.match(c)) for a, b in pairs)]
    return "[" + "".join(map(re.escape, odd)) + "\u0700-\u1fff\u2070-\U0010ffff]"


#: The pattern in terms of the standard library, which is faster, for texts without such characters.
_unlike = re.compile(_unlike_class()).search
_find = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+").findall


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable Latin-1 as itself, the others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Bpe:
    """A byte-level BPE vocabulary, its merges and its special strings."""

    def __init__(self, spec: dict):
        vocab = spec["model"]["vocab"]
        letters = byte_letters()
        self.byte_id = [vocab[c] for c in letters]
        back = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", ())}
        strings = {i: bytes(back[c] for c in s) for s, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.strings = [strings.get(i, b"") for i in range(max(strings, default=-1) + 1)]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        #: What a pair of symbols becomes, with the merge's rank above it in one number; of equal pairs the first merge counts.
        self.merged = {vocab[a] << 32 | vocab[b]: r << 32 | vocab[a + b] for r, (a, b) in reversed(list(enumerate(merges)))}
        #: The same for two bytes.
        self.first = [self.merged.get(self.byte_id[a] << 32 | self.byte_id[b], -1) for a in range(256) for b in range(256)]
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.find = regex.compile(PRE_TOKEN).findall
        self.at_special = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None

    def merge(self, raw: bytes) -> list[int]:
        """The ids of one pre-token. A queue entry is the merge's rank, the place of its left symbol and that merge's outcome; it is stale if the pair there has another outcome by now."""
        sym = [self.byte_id[b] for b in raw]
        first, known = self.first, self.merged.get
        queue = [(m >> 32) << 32 | i for i, (a, b) in enumerate(zip(raw, raw[1:])) if (m := first[a << 8 | b]) >= 0]
        if not queue:
            return sym
        n = len(sym)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heapify(queue)
        while queue:
            top = heappop(queue)
            i = top & 0xFFFFFFFF
            j = after[i]
            if j >= n or sym[i] < 0:
                continue
            m = known(sym[i] << 32 | sym[j], -1)
            if m >> 32 != top >> 32:
                continue
            new = m & 0xFFFFFFFF
            sym[i], sym[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = known(new << 32 | sym[k], -1)
                if m >= 0:
                    heappush(queue, (m >> 32) << 32 | i)
            h = before[i]
            if h >= 0:
                m = known(sym[h] << 32 | new, -1)
                if m >= 0:
                    heappush(queue, (m >> 32) << 32 | h)
        return [s for s in sym if s >= 0]

    def _ids(self, word: str) -> bytes:
        """Of a pre-token that the younger table doesn't hold."""
        ids = self.older.get(word)
        if ids is None:
            ids = array("I", self.merge(word.encode())).tobytes()
        if len(word) <= 64:
            if 2 * len(self.cache) >= CACHED:
                self.older, self.cache = self.cache, {}
            self.cache[word] = ids
        return ids

    def _plain(self, text: str, out: list[bytes]) -> None:
        words = (self.find if _unlike(text) else _find)(text)
        get = self.cache.get
        for word in words:
            ids = get(word)
            if ids is None:
                ids = self._ids(word)
                get = self.cache.get
            out.append(ids)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, end to end."""
        out: list[bytes] = []
        at = 0
        if self.at_special and any(s in text for s in self.special):
            for m in self.at_special.finditer(text):
                self._plain(text[at : m.start()], out)
                out.append(self.special[m[0]].to_bytes(4, "little"))
                at = m.end()
        self._plain(text[at:] if at else text, out)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, array("I", ids))).decode("utf-8", "replace")


def load_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


_codecs: dict[str, Bpe] = {}


def codec(path: str, spec) -> Bpe:
    """The worker's codec for a vocabulary; kept from task to task with its cache."""
    if path not in _codecs:
        _codecs[path] = Bpe(spec.value)
    return _codecs[path]


def bpe_encode_decode(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """Encode each text and decode the ids again.

    Adds to the input's columns `token_ids` (binary: ids as little-endian uint32), `n_tokens` (long) and `decoded` (string).
    A null text is encoded as the empty text: no ids, decoded "". Strings of special tokens in a text become their ids. Rows
    are independent, so repeats, ties and any further columns pass through; an empty table gives an empty table. Columns
    named like the three new ones are replaced. The vocabulary file is read by the driver and sent to the executors, so its
    size (one file of fixed size) is what is broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(load_spec(tokenizer_path))

    def work(texts: list) -> tuple:
        bpe = codec(tokenizer_path, spec)
        ids = [bpe.encode(t or "") for t in texts]
        return ids, [len(x) // 4 for x in ids], [bpe.decode(x) for x in ids]

    return in_python(docs, [text_col], "token_ids binary, n_tokens long, decoded string", work)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_bpe_encoding(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe_encode_decode(docs, tokenizer_path or default_path()).select(
        "doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )
