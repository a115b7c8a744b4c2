"""Token counts (operator 7) under a unigram vocabulary, by dynamic programming over a trie.

The distinct pre-tokens that a task meets are inserted in a trie; the forward score of a node (the best segmentation of the
prefix that leads there) is computed when the node is made, so prefixes that words share are scored once. Nodes where a word
ends hold its number of tokens. A text's count is the sum over its words.
"""

from __future__ import annotations

import math
from pyspark.sql import DataFrame, SparkSession

from .common import in_python, table, words_of

#: Trie nodes of a worker before it starts anew; longer words are scored without leaving nodes.
MAX_NODES, MAX_WORD = 1_000_000, 64
START = "▁"


def load_pieces(path: str) -> list[str]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class Unigram:
    """Pieces with log-probabilities by Zipf's law over their place in the vocabulary; unknown characters are spelled in bytes."""

    def __init__(self, pieces: list[str]):
        norm = math.log(sum(1 / (i + 1) for i in range(len(pieces))) or 1.0)
        self.score = {p: -math.log(i + 1) - norm for i, p in reversed(list(enumerate(pieces)))}
        self.longest = max(map(len, pieces), default=1)
        self.suffixes = {p[i:] for p in pieces for i in range(len(p))}
        self.byte = -math.log(len(pieces) + 256) - norm - 4
        self.clear()

    def clear(self) -> None:
        #: A node: children by letter, best score, tokens of the best segmentation.
        self.root: list = [{}, 0.0, 0]
        self.nodes, self.terminal = 1, {}

    def _forward(self, prefix: str, path: list) -> tuple[float, int]:
        """Best (score, -tokens) of a prefix, from path[k] = (score, tokens) of its own prefixes of k letters."""
        d = len(prefix)
        best, tokens = -math.inf, 0
        get, suffixes = self.score.get, self.suffixes
        for k in range(d - 1, max(0, d - self.longest) - 1, -1):
            piece = prefix[k:]
            if piece not in suffixes:  # nor is any longer one
                break
            s = get(piece)
            if s is not None:
                before = path[k]
                total, n = before[0] + s, before[1] + 1
                if total > best or total == best and n < tokens:
                    best, tokens = total, n
        if best == -math.inf or prefix[-1] not in self.score:
            size = len(prefix[-1].encode("utf-8", "replace"))
            total, n = path[d - 1][0] + size * self.byte, path[d - 1][1] + size
            if total > best:
                best, tokens = total, n
        return best, tokens

    def count(self, word: str) -> int:
        """Tokens of one pre-token."""
        known = self.terminal.get(word)
        if known is not None:
            return known
        text = START + word
        store = len(word) <= MAX_WORD
        if store and self.nodes > MAX_NODES:
            self.clear()
        node, path = self.root, [(0.0, 0)]
        for d, letter in enumerate(text, 1):
            child = node[0].get(letter) if node else None
            if child is None:
                best, tokens = self._forward(text[max(0, d - self.longest) : d], path[max(0, d - self.longest) :]) if d > self.longest else self._forward(text[:d], path)
                if store:
                    child = node[0][letter] = [{}, best, tokens]
                    self.nodes += 1
                path.append((best, tokens))
            else:
                path.append((child[1], child[2]))
            node = child
        if store:
            self.terminal[word] = path[-1][1]
        return path[-1][1]


_models: dict[str, Unigram] = {}


def model_of(path: str, pieces) -> Unigram:
    if path not in _models:
        _models[path] = Unigram(pieces.value)
    return _models[path]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """Adds n_tokens and n_words (long) to docs(.., text).

    Pre-tokens are the runs between ASCII white space. Null, empty and blank texts count 0. Of equally likely segmentations the
    one with fewer tokens counts. Rows are independent: repeats get equal counts, other columns pass through, columns named like
    the new ones are replaced; an empty table gives an empty table. The vocabulary (one file of fixed size) is broadcast.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(load_pieces(vocabulary_path))

    def work(texts: list) -> tuple:
        model = model_of(vocabulary_path, pieces)
        words = [words_of(t) for t in texts]
        return [sum(map(model.count, w)) for w in words], [len(w) for w in words]

    return in_python(docs, ["text"], "n_tokens long, n_words long", work)


def op7_token_counts(spark: SparkSession, sf_dir: str, vocabulary_path: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, vocabulary_path or public_tokenizers.path("piece_bpe_32k.model")).select("doc_id", "n_words", "n_tokens")
