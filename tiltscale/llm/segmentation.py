"""N-best segmentation into the pieces of a SentencePiece vocabulary, and decoding.

The pieces that cover a text form a lattice.  A forward Viterbi pass gives the best score
from the start to every position; a backward A* search from the end takes that score as
its estimate of what is left, which is exact, so paths come out in order of score.

No piece of such a vocabulary runs from one word into the next, so the lattice falls apart
at spaces, and the N best of a text are merged from those of its words.  The forward pass
runs over all new words of one length at once; it also tells what the second best of a word
loses.  Only the words that lose least can differ in one of the N best of a text, so only
those are searched.
"""

import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

SPACE = "▁"
N_BEST = 4
_SEGMENT = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
_LINE_SEGMENT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")
_MEMORY = 250_000
_SEARCHED = 50_000
# Longer words go through the forward pass one by one, and are not remembered.
_LONG = 32
# Characters of texts whose new words are learned together, and words of one forward pass.
_TOGETHER = 1_000_000
_WORDS = 16_384
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def default_path():
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces of a model with scores, and the search over them.

    A unigram model's own scores are log probabilities and stand as they are.  A BPE model
    has ranks instead: its pieces count as log probabilities by Zipf's law.  A character that
    is no piece costs one score per byte, below that of every piece.
    """

    def __init__(self, path, n_best=N_BEST):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.n_best, self.surface, self.bytes, raw = n_best, [], {}, {}
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                raw[piece] = (i, model.get_score(i))
                self.surface.append(piece.replace(SPACE, " ").encode())
        self.unknown = model.unk_id()
        ranks = [s for _, s in raw.values()]
        if all(s <= 0 and s == int(s) for s in ranks):
            best = max(ranks, default=0)
            raw = {p: (i, -math.log(best - s + 2)) for p, (i, s) in raw.items()}
        self.score = {p: (np.array([i], "<u4").tobytes(), s) for p, (i, s) in raw.items()}
        self.longest = max(map(len, raw), default=1)
        self.byte_score = min((s for _, s in raw.values()), default=0.0) - 10.0
        # Nor do pieces run from one line into the next, in most vocabularies.
        self.by_line = not any("\n" in piece for piece in raw)
        self.memory, self.searched = {}, {}
        self._tabulate(raw)

    def _tabulate(self, raw):
        """Hashes of the pieces in order, with their scores and ids."""
        rows = []
        for piece, (i, score) in raw.items():
            h = 0
            for c in piece:
                h = (h * int(_FACTOR) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            rows.append((h, score, i))
        rows.sort()
        self.table = tuple(np.array(c, t) for c, t in zip(zip(*rows), (np.uint64, float, "<u4")))
        self.power = np.ones(_LONG + 1, np.uint64)
        with np.errstate(over="ignore"):
            for i in range(_LONG):
                self.power[i + 1] = self.power[i] * _FACTOR

    def _forward(self, words):
        """Learn words of one length: best ids, what the second best loses, best score."""
        n, size = len(words), len(words[0])
        codes = np.array(words, f"<U{size}").view("<u4").reshape(n, size).astype(np.uint64)
        hashes, scores, ids = self.table
        prefix = np.zeros((size + 1, n), np.uint64)
        forward = np.full((size + 1, n), -np.inf)
        forward[0] = 0.0
        came, piece = np.zeros((size + 1, n), np.int64), np.zeros((size + 1, n), np.int64)
        edges, plain = {}, np.ones(n, bool)
        with np.errstate(over="ignore"):
            for i in range(size):
                prefix[i + 1] = prefix[i] * _FACTOR + codes[:, i] + np.uint64(1)
            for end in range(1, size + 1):
                for start in range(max(0, end - self.longest), end):
                    own = prefix[end] - prefix[start] * self.power[end - start]
                    at = np.minimum(np.searchsorted(hashes, own), len(hashes) - 1)
                    there = hashes[at] == own
                    if start == end - 1:
                        plain &= there
                    if there.any():
                        edges[start, end] = score = np.where(there, scores[at], -np.inf)
                        way = forward[start] + score
                        better = way > forward[end]
                        forward[end][better], came[end][better], piece[end][better] = way[better], start, at[better]
        backward = np.full((size + 1, n), -np.inf)
        backward[size] = 0.0
        for (start, end), score in sorted(edges.items(), key=lambda e: -e[0][0]):
            np.maximum(backward[start], score + backward[end], out=backward[start])
        # Walk back along the best paths.
        rows, at, count = np.arange(n), np.full(n, size), np.zeros(n, np.int64)
        path, on = np.zeros((n, size), "<u4"), np.zeros((size + 1, n), bool)
        while True:
            left = rows[(at > 0) & plain]
            if not len(left):
                break
            ends = at[left]
            on[ends, left] = True
            count[left] += 1
            path[left, size - count[left]] = ids[piece[ends, left]]
            at[left] = came[ends, left]
        # The second best leaves the best somewhere: the best way over an edge it does not take.
        second = np.full(n, -np.inf)
        for (start, end), score in edges.items():
            way = np.where(on[end] & (came[end] == start), -np.inf, forward[start] + score + backward[end])
            np.maximum(second, way, out=second)
        with np.errstate(invalid="ignore"):
            loss = forward[size] - second
        for word, good, c, row, lost, top in zip(words, plain.tolist(), count.tolist(), path, loss.tolist(), forward[size].tolist()):
            if good:
                self.memory[word] = (row[size - c :].tobytes(), max(0.0, lost), top)

    def learn(self, words):
        """Put the words of ``words`` that are not known in memory, unless they are long or hold rare characters."""
        new = {}
        for word in words:
            if word not in self.memory and len(word) <= _LONG:
                new.setdefault(len(word), []).append(word)
        for same in new.values():
            for at in range(0, len(same), _WORDS):
                self._forward(same[at : at + _WORDS])

    def _edges(self, text):
        """For every position, ``(start, score, ids)`` of what ends there; and the Viterbi scores."""
        n, score, longest = len(text), self.score, self.longest
        forward, edges = [0.0] + [-math.inf] * n, [()]
        for end in range(1, n + 1):
            here, top = [], -math.inf
            for start in range(max(0, end - longest), end):
                piece = score.get(text[start:end])
                if piece is not None:
                    here.append((start, piece[1], piece[0]))
                    top = max(top, forward[start] + piece[1])
            if not here or here[-1][0] != end - 1:
                raw = text[end - 1].encode("utf-8", "surrogatepass")
                ids = [self.bytes.get(b, self.unknown) for b in raw]
                cost = self.byte_score * len(ids)
                here.append((end - 1, cost, np.array(ids, "<u4").tobytes()))
                top = max(top, forward[end - 1] + cost)
            edges.append(here)
            forward[end] = top
        return edges, forward

    def search(self, text):
        """``[(score, ids)]``: the best segmentations of a word, the best first.

        Of equal scores the one whose last pieces are longer comes first.
        """
        edges, forward = self._edges(text)
        # A path is its first piece and the path behind it.
        queue, count, found = [(-forward[-1], len(text), 0, 0.0, None)], 0, []
        # Ways to the end come out of a position best first, so more than ``n_best`` of them
        # are never needed; without that, ties could be explored without end.
        taken = {}
        while queue and len(found) < self.n_best:
            _, at, _, behind, path = heapq.heappop(queue)
            taken[at] = taken.get(at, 0) + 1
            if taken[at] > self.n_best:
                continue
            if at == 0:
                ids = []
                while path is not None:
                    ids.append(path[0])
                    path = path[1]
                found.append((behind, b"".join(ids)))
                continue
            for start, score, ids in edges[at]:
                count += 1
                heapq.heappush(queue, (-(forward[start] + score + behind), start, count, score + behind, (ids, path)))
        return found

    def _found(self, word):
        """What ``search`` finds, remembered."""
        found = self.searched.get(word)
        if found is None:
            found = self.search(word)
            if len(word) <= _LONG:
                if len(self.searched) > _SEARCHED:
                    self.searched.clear()
                self.searched[word] = found
        return found

    def _word(self, word):
        """Best ids, what the second best loses, best score."""
        known = self.memory.get(word)
        if known is None:
            found = self._found(word)
            known = (found[0][1], found[0][0] - found[1][0] if len(found) > 1 else math.inf, found[0][0])
            if len(word) <= _LONG:
                self.memory[word] = known
        return known

    def words(self, text):
        """Parts of a text that no piece runs across."""
        if not text:
            return []
        if SPACE in text or "  " in text or text[0] == " " or text[-1] == " ":
            return (_LINE_SEGMENT if self.by_line else _SEGMENT).findall(SPACE + text.replace(" ", SPACE))
        if not self.by_line or "\n" not in text:
            return [SPACE + w for w in text.split(" ")]
        first, *lines = text.split("\n")
        parts = [SPACE + w for w in first.split(" ")]
        for line in lines:
            parts.append("\n")
            head, *words = line.split(" ")
            if head:
                parts.append(head)
            parts += [SPACE + w for w in words]
        return parts

    def encode_all(self, texts):
        """``encode`` of each of ``texts``, whose new words are learned together."""
        if len(self.memory) > _MEMORY:
            self.memory.clear()
        parts = [self.words(t) for t in texts]
        self.learn(set().union(*parts))
        return [self._encode(p) for p in parts]

    def encode(self, text):
        """``[(score, ids)]`` of a whole text, the best first; ``[]`` for an empty one."""
        return self.encode_all([text])[0]

    def _encode(self, words):
        """Only the words whose second best loses least can differ from their best in one of the
        ``n_best``: changing any other word alone loses at least as much.
        """
        if not words:
            return []
        own = list(map(self.memory.get, words))
        if None in own:
            own = [self._word(word) if known is None else known for word, known in zip(words, own)]
        best, losses, tops = zip(*own)
        total, losses = sum(tops), np.array(losses)
        few = np.argsort(losses, kind="stable")[: self.n_best - 1] if len(own) < 1024 else self._least(losses)
        ways = [(0.0, ())]
        for at in sorted(int(i) for i in few if losses[i] < math.inf):
            found = self._found(words[at])
            changes = [(found[0][0] - s, (at, ids)) for s, ids in found]
            merged = [(loss + more, (*way, change)) for loss, way in ways for more, change in changes]
            ways = sorted(merged, key=lambda w: w[0])[: self.n_best]
        out = []
        for loss, way in ways:
            ids = list(best)
            for at, changed in way:
                ids[at] = changed
            out.append((total - loss, b"".join(ids)))
        return out

    def _least(self, losses):
        some = np.flatnonzero(losses <= np.partition(losses, self.n_best - 2)[self.n_best - 2])
        return some[np.argsort(losses[some], kind="stable")][: self.n_best - 1]

    def decode(self, ids):
        """The text of ids, given as bytes of 32-bit integers."""
        surface = self.surface
        raw = b"".join([surface[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


_pieces = {}


def pieces_of(path, n_best):
    """The worker's pieces of a model file, kept from task to task."""
    if (path, n_best) not in _pieces:
        _pieces[path, n_best] = Pieces(path, n_best)
    return _pieces[path, n_best]


def segment(docs, model=None, n_best=N_BEST, with_ids=False, key="doc_id", text="text"):
    """``[doc_id, n_tokens, scores, ids_crc32, restored]`` of every whole text.

    ``scores`` and ``ids_crc32`` are arrays, the best first, of at most ``n_best``; ``n_tokens``
    is of the best, and ``restored`` whether that decodes to the text.  A null text is an empty
    one: no tokens, empty arrays, restored.  ``with_ids`` adds the ids themselves.
    """
    path = model or default_path()
    schema = "doc_id long, n_tokens long, scores array<double>, ids_crc32 array<long>, restored boolean"
    types = [pa.int64(), pa.int64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_()]
    if with_ids:
        schema, types = schema + ", ids array<array<long>>", [*types, pa.list_(pa.list_(pa.int64()))]
    names = [part.split()[0] for part in schema.split(", ")]

    def coded(pieces, batch):
        docs, texts, held = [], [], 0
        for i in range(batch.num_rows + 1):
            if i < batch.num_rows:
                docs.append(batch.column(0)[i])
                texts.append(batch.column(1)[i].as_py() or "")
                held += len(texts[-1])
            if held >= _TOGETHER or i == batch.num_rows:
                yield from zip(docs, texts, pieces.encode_all(texts))
                docs, texts, held = [], [], 0

    def encode(batches):
        pieces = pieces_of(path, n_best)
        for batch in batches:
            rows = []
            for doc, whole, ways in coded(pieces, batch):
                first = ways[0][1] if ways else b""
                row = [
                    doc.as_py(), len(first) // 4, [round(s, 6) for s, _ in ways], [zlib.crc32(i) for _, i in ways],
                    pieces.decode(first) == whole,
                ]
                rows.append(row + [[np.frombuffer(i, "<u4").tolist() for _, i in ways]] * with_ids)
            columns = list(zip(*rows)) or [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(encode, schema)
