"""Paid calls that are made once: equal ones share an answer, and answers outlive what fails.

A call is known by the hash of its prompt and options.  Calls are dealt into parts by that hash;
the task that has a part looks into the part's journal first, asks only what is not there, and
adds answers to the journal every few calls.  So a task that is lost, or a job that is run again,
repeats at most the calls that were under way.  When all calls of a run are in, its answers
become part of a table, from which later runs, of whatever size, leave out what it holds.

    <store>/journal/<parts>/<part>/…    answers of tasks, as they come in
    <store>/answers/run=<id>/…          answers of finished runs
"""

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import functions as F

from tiltscale.operators.lookup import lookup
from tiltscale.operators.rating import asked_safely

_CALL = "__call"
_ANSWERS = f"{_CALL} string, result string, rating_error string"


def call_key(prompt, options):
    """What tells calls apart; null where nothing is asked."""
    return F.sha2(F.concat(F.length(options).cast("string"), F.lit(":"), options, prompt), 256)


class _Journal:
    """Answers of one part, kept in files that are each moved into place when whole."""

    def __init__(self, folder):
        self.files, self.folder = fs.FileSystem.from_uri(folder)
        self.known = {}
        for info in self.files.get_file_info(fs.FileSelector(self.folder, allow_not_found=True)):
            if info.path.endswith(".parquet"):
                table = pq.read_table(info.path, filesystem=self.files)
                self.known.update(zip(table["call"].to_pylist(), table["result"].to_pylist()))

    def add(self, answers):
        if not answers:
            return
        self.files.create_dir(self.folder, recursive=True)
        name = f"{self.folder}/{uuid.uuid4().hex}"
        table = pa.table({"call": list(answers), "result": list(answers.values())})
        pq.write_table(table, f"{name}.tmp", filesystem=self.files)
        self.files.move(f"{name}.tmp", f"{name}.parquet")
        self.known.update(answers)


def _answered(make_client, journal, calls_in_flight, settle_every, batches):
    """``(result, rating_error)`` of each ``(part, call, prompt, options)``; failures are not kept."""
    client, journals = make_client(), {}
    with ThreadPoolExecutor(calls_in_flight) as pool:
        for columns in batches:
            rows = list(zip(*[column.to_pylist() for column in columns]))
            results, errors = [], []
            for at in range(0, len(rows), settle_every):
                some, new, under_way = rows[at : at + settle_every], {}, {}
                for part, call, prompt, options in some:
                    if part not in journals:
                        journals[part] = _Journal(f"{journal}/{part}")
                    if call not in journals[part].known:
                        under_way[call] = (part, pool.submit(asked_safely, client, prompt, options))
                failed = {}
                for call, (part, answer) in under_way.items():
                    result, error = answer.result()
                    if error is None:
                        new.setdefault(part, {})[call] = result
                    else:
                        failed[call] = error
                for part, answers in new.items():
                    journals[part].add(answers)
                results += [journals[part].known.get(call) for part, call, _, _ in some]
                errors += [failed.get(call) for _, call, _, _ in some]
            yield pa.StructArray.from_arrays(
                [pa.array(results, pa.string()), pa.array(errors, pa.string())], ["result", "rating_error"]
            )


def settled_calls(spark, store):
    """``[__call, result]`` of finished runs, one row for each call; empty for a new store."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{store}/answers")
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{_CALL} string, result string")
    answers = spark.read.schema(_ANSWERS).parquet(f"{store}/answers").where("result is not null")
    # Runs at the same time may have asked the same; the smallest text counts.
    return answers.groupBy(_CALL).agg(F.min("result").alias("result"))


def called_once(make_client, store, parts, calls_in_flight=1, settle_every=16):
    """A backend like ``called`` that asks each prompt, with its options, once.

    ``store`` is a folder that every executor can reach.  The calls are made when the backend is
    applied, by ``parts`` tasks, and written; the rows then meet the answers in a join that spreads
    contents which many rows share.  A call that failed is an error of all its rows in this
    run, and is made again in the next.  A task that is lost repeats at most ``settle_every`` calls,
    and so does a run with the same ``parts`` after one that failed.
    """
    journal = f"{store}/journal/{parts}"

    def answer(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        yield from _answered(make_client, journal, calls_in_flight, settle_every, batches)

    ask = F.arrow_udf(answer, "result string, rating_error string").asNondeterministic()

    def backend(df, measure):
        spark = df.sparkSession
        keyed = df.withColumn(_CALL, call_key(F.col("prompt"), F.col("options")))
        before = settled_calls(spark, store)
        # Copies become one before they are shuffled; the prompt is the key's own text.
        calls = keyed.where(F.col(_CALL).isNotNull()).select(_CALL, "prompt", "options").distinct()
        calls = calls.join(before.select(_CALL), _CALL, "left_anti")
        part = F.pmod(F.xxhash64(_CALL), F.lit(parts)).cast("int")
        dealt = calls.withColumn("__part", part).repartition(parts, "__part")
        run = f"{store}/answers/run={uuid.uuid4().hex}"
        asked = dealt.withColumn("__answer", ask("__part", _CALL, "prompt", "options"))
        asked.select(_CALL, F.inline(F.array("__answer"))).write.parquet(run)
        new = spark.read.schema(_ANSWERS).parquet(run)
        answers = before.withColumn("rating_error", F.lit(None).cast("string")).unionByName(new)
        return lookup(keyed, answers, [_CALL]).drop(_CALL)

    return backend
