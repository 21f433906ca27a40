"""Texts of the elements of a page that hold its article.

Pages are parsed by the standard library's tokenizer under forgiving rules: no
end tag is implied, an end tag closes the nearest open element of its name and
all inside it, an end tag without one only ends the text run, and void elements
close at once.  Each text run is stripped by itself and runs are joined without
a separator.  Spark has no expression for this, so it is an Arrow function; it
keeps the columns around it, and with them the partitioning by URL.

Unclosed paragraphs nest, so the texts of one page may add up to the square of its
size.  ``select_blocks`` holds them as one value; ``block_rows`` makes rows of them,
a bounded batch at a time.
"""

import html.entities
from collections.abc import Iterator
from html.parser import HTMLParser
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements that never hold anything, and elements whose text is
# not part of the text around them.
_VOID = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link menuitem meta"
    " nextid param source spacer track wbr".split()
)
_HIDDEN_TEXT = frozenset("rp rt script style template".split())


_BLOCKS = pa.list_(pa.string())


class _BlockParser(HTMLParser):
    """Collects stripped text runs and, per wanted element, the runs inside it."""

    def __init__(self, element, class_token):
        super().__init__(convert_charrefs=False)
        self.element, self.class_token = element, class_token
        self.open = []  # (name, index into spans or None)
        self.open_names = {}
        self.hidden = 0
        self.pending = []  # pieces of the current text run
        self.runs = []
        self.spans = []  # [first run, end run] of each wanted element
        self.void_closed = {}  # void elements whose own end tag may follow, counted

    def updatepos(self, i, j):
        """Line numbers are of no use here and cost a pass over the text."""
        return j

    def end_run(self):
        if self.pending:
            run = "".join(self.pending).strip()
            self.pending.clear()
            if run and not self.hidden:
                self.runs.append(run)

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in _VOID:
            self._end(tag)
            self.void_closed[tag] = self.void_closed.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.void_closed.get(tag):
            self.void_closed[tag] -= 1
        else:
            self._end(tag)

    def _start(self, tag, attrs):
        self.end_run()
        span = None
        if tag == self.element and (
            self.class_token is None or self.class_token in (dict(attrs).get("class") or "").split()
        ):
            span = len(self.spans)
            self.spans.append([len(self.runs), None])
        self.open.append((tag, span))
        self.open_names[tag] = self.open_names.get(tag, 0) + 1
        self.hidden += tag in _HIDDEN_TEXT

    def _end(self, tag):
        self.end_run()
        if not self.open_names.get(tag):
            return
        name = None
        while name != tag:
            name, span = self.open.pop()
            self.open_names[name] -= 1
            self.hidden -= name in _HIDDEN_TEXT
            if span is not None:
                self.spans[span][1] = len(self.runs)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        known = html.entities.html5
        self.pending.append(known.get(name + ";") or known.get(name) or "&" + name)

    def handle_charref(self, name):
        point = int(name[1:], 16) if name[0] in "xX" else int(name)
        try:
            text = bytes([point]).decode("cp1252") if point < 256 else chr(point)
        except (ValueError, OverflowError):
            text = chr(point) if point < 256 else ""
        self.pending.append(text or "\N{REPLACEMENT CHARACTER}")

    def handle_comment(self, data):
        self.end_run()

    def handle_decl(self, decl):
        self.end_run()

    def handle_pi(self, data):
        self.end_run()

    def unknown_decl(self, data):
        self.end_run()
        if data.upper().startswith("CDATA["):
            # Character data counts as text wherever it stands.
            run = data[len("CDATA["):].strip()
            if run:
                self.runs.append(run)

    def texts(self):
        """One text after the other, as parts of the text of all runs, which is held once."""
        self.end_run()
        whole = "".join(self.runs)
        starts = [0, *accumulate(map(len, self.runs))]
        for first, end in self.spans:
            yield whole[starts[first] : starts[len(self.runs) if end is None else end]]


def iterate_blocks(page, element, class_token=None):
    """Iterator over the block texts of one page in document order; None where it cannot be parsed."""
    parser = _BlockParser(element, class_token)
    try:
        parser.feed(page)
        parser.close()
    except AssertionError:  # how the tokenizer refuses a broken declaration
        return None
    return parser.texts()


def block_texts(page, element, class_token=None):
    """The same as a list."""
    texts = iterate_blocks(page, element, class_token)
    return None if texts is None else list(texts)


# Characters of block text after which an output batch is closed.  Unclosed
# paragraphs repeat the text in them, so output can be far larger than its page.
_BATCH_CHARACTERS = 16 * 1024 * 1024


def _blocks_of_batches(
    batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]],
) -> Iterator[pa.Array]:
    for batch in batches:
        found, size = [], 0
        for page, element, class_token in zip(*batch):
            whole = page.is_valid and element.is_valid
            texts = block_texts(page.as_py(), element.as_py(), class_token.as_py()) if whole else None
            found.append(texts)
            size += sum(map(len, texts or ()))
            if size > _BATCH_CHARACTERS:
                yield pa.array(found, _BLOCKS)
                found, size = [], 0
        yield pa.array(found, _BLOCKS)


# Declared non-deterministic so that the optimizer never evaluates it twice; it
# would, for instance, to filter pages before their blocks are exploded.
_select_blocks = F.arrow_udf(_blocks_of_batches, T.ArrayType(T.StringType())).asNondeterministic()


def select_blocks(page, element, class_token=None):
    """``array<string>`` of block texts; null for a null page or element."""
    no_class = F.lit(None).cast("string")
    return _select_blocks(page, element, no_class if class_token is None else class_token)


def _rows_of_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = batch.select(range(batch.num_columns - 3))
        owners, numbers, texts, size = [], [], [], 0

        def closed(kept=kept):
            columns = [pa.array(numbers, pa.int32()), pa.array(texts, pa.string())]
            taken = kept.take(pa.array(owners, pa.int64())).columns
            return pa.RecordBatch.from_arrays([*taken, *columns], [*kept.schema.names, *BLOCK_COLUMNS])

        for owner, (page, element, class_token) in enumerate(zip(*batch.columns[-3:])):
            if not (page.is_valid and element.is_valid):
                continue
            for number, text in enumerate(iterate_blocks(page.as_py(), element.as_py(), class_token.as_py()) or ()):
                owners.append(owner)
                numbers.append(number)
                texts.append(text)
                size += len(text) + _ROW_CHARACTERS
                if size > _BATCH_CHARACTERS:
                    yield closed()
                    owners, numbers, texts, size = [], [], [], 0
        yield closed()


# Columns of a block's row, and what a row counts for beside its text when a batch is closed.
BLOCK_COLUMNS = ("block_no", "block_text")
_ROW_CHARACTERS = 64


def block_rows(pages, page, element, class_token=None, keep=None):
    """One row per block: the columns ``keep``, ``block_no`` (from 0) and ``block_text``.

    ``page``, ``element`` and ``class_token`` are columns of ``pages``; ``keep`` names the
    columns that go with each block, all by default.  Pages without a block, and null or
    unreadable ones, have no row.  A worker holds one page, its text and one batch of
    rows, however often texts repeat within each other.  Kept columns that are named like
    those of a block are refused.
    """
    names = pages.columns if keep is None else list(keep)
    clashing = {c.lower() for c in names} & set(BLOCK_COLUMNS)
    if clashing:
        raise ValueError(f"columns named like those of a block: {sorted(clashing)}")
    no_class = F.lit(None).cast("string")
    asked = [page, element, no_class if class_token is None else class_token]
    given = pages.select(*[pages[c] for c in names], *[c.cast("string").alias(f"__{i}") for i, c in enumerate(asked)])
    block = T.StructType([T.StructField("block_no", T.IntegerType()), T.StructField("block_text", T.StringType())])
    return given.mapInArrow(_rows_of_batches, T.StructType([*pages.select(*[pages[c] for c in names]).schema, *block]))
