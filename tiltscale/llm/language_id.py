"""Language identification by cross-parsing entropy.

The labelled text of each language becomes a suffix automaton.  A document is parsed
against each: the longest match from where the last ended is a phrase.  Text is cheap to
say in the words of its own language, so the language that needs the fewest phrases per
character, weighted by the bits it takes to point into its text, wins.

Phrases do not run across words, so the parse of a document is the sum of those of its
words, and a worker parses a word once.
"""

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

# Bounds of the sample a model is fitted to: rows per language, characters of a row,
# characters per language.
SAMPLE_ROWS = 400
SAMPLE_ROW_CHARS = 2_000
SAMPLE_CHARS = 80_000
UNDETERMINED = "und"
# Above so many phrases per character no learned language fits the text.
MOST_PHRASES = 0.8

# Groups of input partitions whose samples are merged first.
_SLICES = 1024
# Words a worker remembers, and their characters, beyond which it starts anew.
_MEMORY, _MEMORY_CHARACTERS = 400_000, 16_000_000
# Characters of texts whose new words are parsed together; longer words go one by one.
_TOGETHER, _LONG = 1_000_000, 64
# Cells of all automata together, up to which they are dense tables.
_TABLE_CELLS = 40_000_000


def words_of(text):
    """Runs of letters of a text, in lower case."""
    return "".join(c if c.isalpha() else " " for c in text.lower()).split()


class SuffixAutomaton:
    """All substrings of a set of words; ``step`` maps (state, letter) to the next state."""

    def __init__(self, words):
        self.step = {}
        links, lengths, nexts = [-1], [0], [{}]
        for word in words:
            last = 0
            for letter in f" {word} ":
                last = self._extend(links, lengths, nexts, last, letter)
        for state, letters in enumerate(nexts):
            for letter, after in letters.items():
                self.step[state, letter] = after

    @staticmethod
    def _extend(links, lengths, nexts, last, letter):
        """Append a letter to what ends in ``last``; the new last state."""

        def split(p, q):
            clone = len(lengths)
            lengths.append(lengths[p] + 1)
            links.append(links[q])
            nexts.append(dict(nexts[q]))
            links[q] = clone
            while p >= 0 and nexts[p].get(letter) == q:
                nexts[p][letter] = clone
                p = links[p]
            return clone

        known = nexts[last].get(letter)
        if known is not None:
            return known if lengths[known] == lengths[last] + 1 else split(last, known)
        state = len(lengths)
        lengths.append(lengths[last] + 1)
        links.append(0)
        nexts.append({})
        p = last
        while p >= 0 and letter not in nexts[p]:
            nexts[p][letter] = state
            p = links[p]
        if p >= 0:
            q = nexts[p][letter]
            links[state] = q if lengths[q] == lengths[p] + 1 else split(p, q)
        return state

    def phrases(self, word):
        """Number of longest matches that make up a word; an unknown letter is one of its own."""
        step, state, count = self.step, 0, 0
        for letter in f" {word} ":
            after = step.get((state, letter))
            if after is None:
                count += state > 0
                after = step.get((0, letter), 0)
                count += after == 0
            state = after
        return count + (state > 0)


class Model:
    """Languages with their automata, and the weight of a phrase in each."""

    def __init__(self, texts):
        self.languages = sorted(texts)
        self.automata = [SuffixAutomaton(sorted({w for t in texts[name] for w in words_of(t)})) for name in self.languages]
        # A phrase is named by a place in the text it is found in.
        self.bits = np.array([math.log2(max(2, sum(map(len, texts[name])))) for name in self.languages])

    def word(self, word):
        return [a.phrases(word) for a in self.automata]


class Parser(dict):
    """Word between white space → row of ``counts``: phrases by language, then letters.

    Words of one length that are new to a batch of texts step through the automata side by
    side, which are dense tables then, unless those would be large.
    """

    def __init__(self, model):
        super().__init__()
        self.model = model
        letters = sorted({letter for a in model.automata for _, letter in a.step})
        place = {letter: i + 1 for i, letter in enumerate(letters)}
        self.letters = np.array([ord(c) for c in letters], np.uint32)
        states = [1 + max(a.step.values(), default=0) for a in model.automata]
        self.tables = None
        if sum(states) * (len(letters) + 1) <= _TABLE_CELLS:
            self.tables = []
            for automaton, count in zip(model.automata, states):
                # Letter 0 stands for those that no language has.
                table = np.full((count, len(letters) + 1), -1, np.int32)
                for (state, letter), after in automaton.step.items():
                    table[state, place[letter]] = after
                self.tables.append(table)
        self.forget()

    def forget(self):
        self.clear()
        self.held = 0
        self.counts = np.zeros((1024, len(self.model.languages) + 1), np.int64)

    def _side_by_side(self, words):
        """Phrases of words of one length, by language."""
        padded = [f" {w} " for w in words]
        codes = np.array(padded, f"<U{len(padded[0])}").view("<u4").reshape(len(words), -1)
        at = np.minimum(np.searchsorted(self.letters, codes), len(self.letters) - 1)
        codes = np.where(self.letters[at] == codes, at + 1, 0)
        out = np.zeros((len(words), len(self.tables)), np.int64)
        for j, table in enumerate(self.tables):
            state, count = np.zeros(len(words), np.int64), out[:, j]
            for letter in codes.T:
                after = table[state, letter]
                ended = after < 0
                count += ended & (state > 0)
                after = np.where(ended, table[0, letter], after)
                alone = after < 0
                count += alone
                state = np.where(alone, 0, after)
            count += state > 0
        return out

    def learn(self, chunks):
        """Put ``chunks``, none of them known, into the table."""
        parts = [words_of(c) for c in chunks]
        by_length, phrases = {}, {}
        for word in set().union(*parts):
            by_length.setdefault(len(word), []).append(word)
        for length, words in by_length.items():
            if self.tables and length <= _LONG:
                phrases.update(zip(words, self._side_by_side(words)))
            else:
                phrases.update((w, np.array(self.model.word(w))) for w in words)
        first = len(self)
        while len(self.counts) < first + len(chunks):
            self.counts = np.concatenate([self.counts, np.zeros_like(self.counts)])
        for at, (chunk, words) in enumerate(zip(chunks, parts), first):
            own = self.counts[at]
            for word in words:
                own[:-1] += phrases[word]
                own[-1] += len(word)
            self[chunk] = at
            self.held += len(chunk)

    def judge_all(self, texts):
        """``(language, score, phrases per letter)`` of each of some whole texts."""
        if len(self) > _MEMORY or self.held > _MEMORY_CHARACTERS:
            self.forget()
        parts = [t.split() if t else [] for t in texts]
        if self.model.languages:
            self.learn(list(set().union(*parts).difference(self)))
        return [self._judge(p) for p in parts]

    def _judge(self, chunks):
        if not chunks or not self.model.languages:
            return UNDETERMINED, 0.0, 0.0
        total = self.counts[np.fromiter(map(self.__getitem__, chunks), np.int64, len(chunks))].sum(axis=0)
        letters = int(total[-1])
        if not letters:
            return UNDETERMINED, 0.0, 0.0
        rates = total[:-1] * self.model.bits / letters
        best, *rest = np.argsort(rates, kind="stable").tolist()
        score = 1.0 - rates[best] / rates[rest[0]] if rest else 1.0
        return self.model.languages[best], float(min(1.0, max(0.0, score))), float(total[best] / letters)


def _judged(parser, column):
    """What ``parser`` makes of an Arrow column of texts, some of them at a time."""
    texts, held = [], 0
    for value in column:
        texts.append(value.as_py())
        held += len(texts[-1] or "")
        if held > _TOGETHER:
            yield from parser.judge_all(texts)
            texts, held = [], 0
    yield from parser.judge_all(texts)


def held_out(doc_id):
    """Whether a document is kept from learning: CRC-32 of its id's digits, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(labelled, lang="lang", text="text", order="doc_id", rows=SAMPLE_ROWS, row_chars=SAMPLE_ROW_CHARS, chars=SAMPLE_CHARS):
    """A model of the languages in ``labelled``, of at most ``chars`` characters each.

    The sample: of each language the ``rows`` with the lowest hash of ``order`` and text, as
    far as ``chars`` reach, and ``row_chars`` of a row.  That is all the driver gets, and it
    does not grow with the table.  Rows without a language or a letter teach nothing.
    """
    usable = labelled.where(F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}"))
    excerpt = usable.select(
        F.col(lang).alias("lang"), F.substring(F.col(text), 1, row_chars).alias("text"),
        F.xxhash64(F.col(order).cast("string"), F.col(text)).alias("h"),
    )
    # Spark keeps the first rows of each language before it shuffles them; what many input
    # partitions keep meets slice by slice, so that no task gets the rows of all of them.
    excerpt = excerpt.withColumn("slice", F.pmod(F.spark_partition_id(), F.lit(_SLICES)))
    by_slice = F.row_number().over(Window.partitionBy("lang", "slice").orderBy("h", "text"))
    excerpt = excerpt.withColumn("m", by_slice).where(F.col("m") <= rows)
    first = F.row_number().over(Window.partitionBy("lang").orderBy("h", "text"))
    sample = excerpt.withColumn("n", first).where(F.col("n") <= rows).orderBy("lang", "n").collect()
    texts, sizes = {}, {}
    for row in sample:
        if sizes.get(row.lang, 0) < chars:
            texts.setdefault(row.lang, []).append(row.text)
            sizes[row.lang] = sizes.get(row.lang, 0) + len(row.text)
    return Model(texts)


_parser = {}


def _parser_of(key, model):
    """A worker's parser, kept from task to task for as long as the model is the same."""
    if _parser.get("key") != key:
        _parser.update(key=key, parser=Parser(model.value))
    return _parser["parser"]


def identify(docs, model, text="text"):
    """Add ``lang_pred``, ``score`` and ``phrases`` (per letter, in the language that won).

    A null text, or one without a letter, is ``und`` with score 0; so is every text when
    nothing was learned.  The score is the lead over the second language, from 0 (a tie,
    which goes to the name that sorts first) to 1 (no other language).
    """
    spark = docs.sparkSession
    shared, key = spark.sparkContext.broadcast(model), uuid.uuid4().hex
    names = [c for c in docs.columns if c != text]
    schema = docs.select(*names).schema.add("lang_pred", "string").add("score", "double").add("phrases", "double")

    def judge(batches):
        parser = _parser_of(key, shared)
        for batch in batches:
            judged = list(_judged(parser, batch.column(len(names))))
            lang, score, phrases = zip(*judged) if judged else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(phrases, pa.float64())],
                names=[*names, "lang_pred", "score", "phrases"],
            )

    return docs.select(*names, text).mapInArrow(judge, schema)


def accepted(docs, model, most=MOST_PHRASES, text="text"):
    """Rows of ``docs`` in a language the model knows, as they are.

    Rejected are texts that are ``und``, and those that take over ``most`` phrases per letter
    in every language: words of none of them.
    """
    shared, key = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    place = docs.columns.index(text)

    def choose(batches):
        parser = _parser_of(key, shared)
        for batch in batches:
            keep = [lang != UNDETERMINED and phrases <= most for lang, _, phrases in _judged(parser, batch.column(place))]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(choose, docs.schema)


def learn_and_identify(docs):
    """``[doc_id, held_out, lang_pred, score, phrases]``, learned from documents not held out."""
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return identify(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model)
