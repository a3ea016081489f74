"""Operator 8: token counts by trie-shared dynamic programming over a unigram vocabulary."""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from plumbline.llm.bpe import spans
from plumbline.llm.common import read

#: Stands for the space before a word in the pieces.
MARK = "▁"
#: What a byte of a character without a piece costs besides the rarest piece.
BYTE_PENALTY = 10.0
#: A task forgets its distinct pre-tokens beyond so many.
KEPT_WORDS = 300_000


class UnigramPieces:
    """Log probabilities of the pieces of a vocabulary file.

    The vocabulary orders its pieces by how early they were merged; nothing is trained, so the piece at place k
    weighs 1 / (k + 2), as frequencies by rank do, normalised over all pieces. Pieces of bytes are the fall-back.
    """

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        plain.sort(key=lambda i: (-model.get_score(i), i))
        norm = math.log(sum(1 / (k + 2) for k in range(len(plain))))
        self.logp = {model.id_to_piece(i): -math.log(k + 2) - norm for k, i in enumerate(plain)}
        self.byte = -math.log(len(plain) + 2) - norm - BYTE_PENALTY
        #: Every end of a piece: its log probability, or None where it is only an end.
        self.ends: dict[str, float | None] = {}
        for piece in self.logp:
            for i in range(len(piece)):
                self.ends.setdefault(piece[i:], self.logp.get(piece[i:]))

    def count(self, words: list[str]) -> tuple[list[int], list[float]]:
        """Tokens and log probability of the best segmentation of each word; the fewest tokens if equal.

        The words in order are the leaves of their trie from left to right. The forward scores of the nodes on
        the path to a word (best, tokens) are kept on a stack; the next word starts at the deepest node they
        share, so that each node of the trie is scored once. What stands at a word's last node is its result.
        """
        ends, path = self.ends, ""
        best, tokens = [0.0], [0]
        found: dict[str, tuple[int, float]] = {}
        for word in sorted(words):
            path_size, size, depth = len(path), len(word), 0
            while depth < path_size and depth < size and path[depth] == word[depth]:
                depth += 1
            del best[depth + 1 :], tokens[depth + 1 :]
            for i in range(depth + 1, size + 1):
                top, least, begin = -math.inf, 0, i - 1
                alone = ends.get(word[begin:i])
                if alone is None:
                    many = len(word[begin:i].encode("utf-8", "surrogatepass"))
                    top, least = best[begin] + many * self.byte, tokens[begin] + many
                while begin >= 0 and (piece := word[begin:i]) in ends:
                    if (p := ends[piece]) is not None:
                        score, n = best[begin] + p, tokens[begin] + 1
                        if score > top or score == top and n < least:
                            top, least = score, n
                    begin -= 1
                best.append(top)
                tokens.append(least)
            path = word
            found[word] = tokens[-1], best[-1]
        return [found[w][0] for w in words], [found[w][1] for w in words]


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens, log_prob of every row of docs(doc_id, text).

    Pre-tokens are the runs without [\\x20\\x09-\\x0D], each with a mark for the space before it; a document's
    tokens and log probability are sums over its pre-tokens. Null and empty texts have none. Repeated rows are
    counted alike; other columns are ignored. No shuffle: each task scores its own distinct pre-tokens.
    """
    shared = docs.sparkSession.sparkContext.broadcast(UnigramPieces(vocabulary_path))  # a fixed vocabulary

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, number = shared.value, defaultdict()
        number.default_factory = number.__len__
        tokens, logp = np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for begin, end in spans(batch.column(1), 8 << 20):
                part = batch.slice(begin, end - begin)
                if len(number) > KEPT_WORDS:
                    number.clear()
                    tokens, logp = tokens[:0], logp[:0]
                docs = []
                for x in part.column(1):
                    words = (x.as_py() or "").encode("utf-8", "surrogatepass").split()
                    docs.append(np.fromiter(map(number.__getitem__, words), np.int64, len(words)))
                new = [MARK + w.decode("utf-8", "surrogatepass") for w in list(number)[len(tokens) :]]
                a, b = pieces.count(new)
                tokens, logp = np.concatenate((tokens, np.array(a, np.int64))), np.concatenate((logp, np.array(b, float)))
                columns = [pa.array([len(d) for d in docs], pa.int64()), pa.array([int(tokens[d].sum()) for d in docs], pa.int64()), pa.array([float(logp[d].sum()) for d in docs], pa.float64())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "n_words", "n_tokens", "log_prob"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, log_prob double")


def default_pieces() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its token count; see token_counts."""
    return token_counts(read(spark, sf_dir, "documents"), default_pieces())
