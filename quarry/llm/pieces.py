"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A text becomes marked words: blanks turn into U+2581, one is put in front, and words start at the marks. No piece crosses
into the next word, so words are encoded alone. The distinct words of a batch are sorted, which walks their trie depth first:
the forward table of the prefix that a word shares with the one before is kept, and only the rest is computed.

The forward step takes, for each end, the piece that ends the best path there. For a unigram model that is the path of the
highest score. For a BPE model exactly one piece can follow the path to its start, the one whose pair with the path's last
piece no merge would cross; so the table yields the merges' own result, and ids equal those of the model's library.

Defined results: null and empty texts have no ids and decode to the empty text; characters without a piece become byte pieces;
a text round-trips unless it holds U+2581 itself, which decodes to a blank; repeated rows are encoded each; an empty table
gives an empty result; other columns are kept and may have any names but those added.
"""

import heapq
import re
import uuid
from array import array
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices, tidy

MARK = "▁"
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Words kept since the last turn-over, and pairs judged. Beyond, words not met again until the next turn-over are forgotten.
KEPT, PAIRS = 200_000, 400_000
UNKNOWN_PENALTY = 10.0


class Model(NamedTuple):
    """What the model file holds, as it is sent to the tasks: its size is that of the vocabulary."""

    pieces: list[str]
    scores: list[float]
    byte_ids: list[int]
    special: list[int]
    kind: str


def load(path: str = DEFAULT_MODEL, kind: str = "bpe") -> Model:
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = range(p.vocab_size())
    pieces = [p.id_to_piece(i) for i in ids]
    byte_ids = [p.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    assert all(p.is_byte(i) for i in byte_ids), "characters without a piece need byte pieces"
    return Model(pieces, [p.get_score(i) for i in ids], byte_ids, [i for i in ids if p.is_control(i) or p.is_unknown(i) or p.is_unused(i)], kind)


class Encoder:
    def __init__(self, model: Model):
        self.model = model
        off = {*model.byte_ids, *model.special}
        self.id = {p: i for i, p in enumerate(model.pieces) if i not in off}
        self.score = {p: model.scores[i] for p, i in self.id.items()}
        self.unknown = min(self.score.values()) - UNKNOWN_PENALTY
        order = {s: r for r, s in enumerate(sorted(set(self.score.values()), reverse=True))}
        self.rank = {p: order[s] for p, s in self.score.items()}
        self.ends: dict = {}  # the pieces as a trie, read from their ends; "" holds the id
        for p, i in self.id.items():
            node = self.ends
            for c in reversed(p):
                node = node.setdefault(c, {})
            node[""] = i
        self.follows: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        alone = "" if "\n" in self.id else "\n"  # a character without a piece ends words, as no merge crosses it
        self.word = re.compile(f"{MARK}*[^{MARK}{alone}]+|{MARK}+" + "|\n" * bool(alone))
        whole = [b"" for _ in model.pieces]
        for p, i in self.id.items():
            whole[i] = p.encode()
        for b, i in enumerate(model.byte_ids):
            whole[i] = bytes([b])
        self.bytes = whole

    def words(self, text: str) -> list[str]:
        return self.word.findall(MARK + text.replace(" ", MARK)) if text else []

    def merged(self, symbols: list[str]) -> list[str]:
        """The merges played through: the best-scored neighbours first, the leftmost of equals.

        A heap holds what may merge by rank and place, and neighbours are linked, so n symbols take n log n steps.
        """
        own, rank = list(symbols), self.rank
        n = len(own)
        if n <= 24:  # a few symbols are looked through again for each merge
            while True:
                best, at = None, -1
                for i in range(len(own) - 1):
                    r = rank.get(own[i] + own[i + 1])
                    if r is not None and (best is None or r < best):
                        best, at = r, i
                if at < 0:
                    return own
                own[at : at + 2] = [own[at] + own[at + 1]]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        open_ = [r << 40 | i for i in range(n - 1) if (r := rank.get(own[i] + own[i + 1])) is not None]
        heapq.heapify(open_)
        while open_:
            x = heapq.heappop(open_)
            i = x & 0xFFFFFFFFFF
            j = after[i]
            if not own[i] or j >= n or rank.get(own[i] + own[j]) != x >> 40:  # one of the two has merged since
                continue
            own[i], own[j] = own[i] + own[j], ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := rank.get(own[i] + own[k])) is not None:
                    heapq.heappush(open_, r << 40 | i)
            if (h := before[i]) >= 0 and (r := rank.get(own[h] + own[i])) is not None:
                heapq.heappush(open_, r << 40 | h)
        return [x for x in own if x]

    def _may_follow(self, before: int, piece: int) -> bool:
        """Whether the merges of both leave the piece as it is; before: the piece ahead, -1 for none, -2 - c for a character without one."""
        if len(self.follows) > PAIRS:
            self.follows.clear()
        last = self.model.pieces[piece]
        ahead = [self.model.pieces[before]] if before >= 0 else [chr(-2 - before)] if before < -1 else []
        found = self.follows[before << 32 | piece] = self.merged([*"".join(ahead), *last]) == [*ahead, last]
        return found

    def _sorted(self, words: list[str]) -> Iterator[tuple[str, list[int]]]:
        """(word, its ids, or code points as -2 - c where there is no piece), words in order.

        last[i] is the piece that ends the best path of i characters, and came[i] how many lie before it.
        """
        bpe, follows, scores, ends = self.model.kind == "bpe", self.follows, self.model.scores, self.ends
        last, came, best, before = [-1], [0], [0.0], ""
        for w in words:
            if bpe and w.startswith(MARK * 2):  # pieces of blanks alone share one score, and then order decides: no single piece can follow
                yield w, [self.id[p] if p in self.id else -2 - ord(p) for p in self.merged([*w])]
                continue
            k = 0
            for a, b in zip(before, w, strict=False):
                if a != b:
                    break
                k += 1
            del last[k + 1 :], came[k + 1 :], best[k + 1 :]
            for i in range(k + 1, len(w) + 1):
                node, j, found = ends, i, []
                while j:
                    node = node.get(w[j - 1])
                    if node is None:
                        break
                    j -= 1
                    if "" in node:
                        found.append((node[""], j))
                alone = bool(found) and found[0][1] == i - 1  # the character itself is a piece
                if bpe:
                    for x, j in reversed(found):
                        p = last[j]
                        ok = follows.get(p << 32 | x)
                        if self._may_follow(p, x) if ok is None else ok:
                            break
                    else:
                        x, j = found[0][0] if alone else -2 - ord(w[i - 1]), i - 1
                    last.append(x)
                    came.append(j)
                    continue
                ways = [(best[j] + scores[x], -j, x) for x, j in found] + [(best[i - 1] + self.unknown, 1 - i, -2 - ord(w[i - 1]))] * (not alone)
                value, j, x = max(ways)
                last.append(x)
                came.append(-j)
                best.append(value)
            before, out, i = w, [], len(w)
            while i:
                out.append(last[i])
                i = came[i]
            out.reverse()
            yield w, out

    def learn(self, words: set[str]) -> None:
        """Encode the words that are not kept yet; those kept before the last turn-over are taken along."""
        if len(self.kept) > KEPT:
            self.old, self.kept = self.kept, {}
        byte_ids = self.model.byte_ids
        fresh = words.difference(self.kept)
        for w in fresh.intersection(self.old):
            self.kept[w] = self.old[w]
        for w, ids in self._sorted(sorted(fresh.difference(self.old))):
            if min(ids) < 0:
                ids = [y for x in ids for y in ([x] if x >= 0 else [byte_ids[b] for b in chr(-2 - x).encode()])]
            self.kept[w] = array("i", ids).tobytes()

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        cut = [self.words(t or "") for t in texts]
        self.learn(set().union(*cut))
        return [np.frombuffer(b"".join(map(self.kept.__getitem__, w)), "<i4") for w in cut]

    def decode(self, ids: np.ndarray) -> str:
        text = b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if text[:1] == " " else text


_ENCODERS: dict[str, Encoder] = {}


def _encoder(at: str, sent: Broadcast) -> Encoder:
    """The encoder of a call: a worker keeps it, with the pairs it has judged, from task to task; words go when a task ends."""
    if at not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[at] = Encoder(Model(*sent.value))
    return _ENCODERS[at]


def encode(docs: DataFrame, model: Model | None = None, text: str = "text", check: bool = True) -> DataFrame:
    """docs with token_ids, n_tokens and, with check, round_trip: whether the ids decode to the text again."""
    sent = docs.sparkSession.sparkContext.broadcast(tuple(model or load()))
    at, place = uuid.uuid4().hex, docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(at, sent)
        try:
            for b in slices(batches, 250, 2 << 20):
                texts = b.column(place).to_pylist()
                ids = encoder.encode_all(texts)
                sizes = np.array([len(x) for x in ids], np.int32)
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.zeros(0, "<i4")]).astype(np.int32)))
                more = [lists, pa.array(sizes.astype(np.int64))] + [pa.array([encoder.decode(x) == (t or "") for x, t in zip(ids, texts, strict=True)], pa.bool_())] * check
                yield pa.RecordBatch.from_arrays([*b.columns, *more], names=[*b.schema.names, "token_ids", "n_tokens", "round_trip"][: b.num_columns + 2 + check])
        finally:
            encoder.kept, encoder.old = {}, {}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(tidy(run), f"{schema}, token_ids array<int>, n_tokens long" + ", round_trip boolean" * check)


def decode(encoded: DataFrame, model: Model | None = None, ids: str = "token_ids") -> DataFrame:
    """encoded with the column decoded, the text of its ids; null ids give the empty text."""
    sent = encoded.sparkSession.sparkContext.broadcast(tuple(model or load()))
    at = uuid.uuid4().hex

    @F.pandas_udf("string")
    def text_of(lists: pd.Series) -> pd.Series:
        encoder = _encoder(at, sent)
        return lists.map(lambda x: encoder.decode(np.asarray([] if x is None else x, "<i4")))

    return encoded.withColumn("decoded", text_of(ids))
