"""Where outside models and transducers come in: each takes a plain Python function and calls it on
batches, on the executors. Functions have to be importable there, or to travel with the job."""

from __future__ import annotations

import contextlib
import queue
import shlex
import subprocess
import threading
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexloom.functions.gloss import keep_segmentation
from lexloom.operators.morph import analyse
from lexloom.operators.sizes import broadcast_if_small


def generated(prompts: DataFrame, model: Callable[[list[str]], Sequence[str]], prompt: str = "prompt", size: int = 16) -> DataFrame:
    """Rows with columns generated and error: the model's answers to batches of ``size`` prompts. A
    batch that fails is tried prompt by prompt, so only what fails alone has an error and no answer."""
    schema = T.StructType([*prompts.schema.fields, T.StructField("generated", T.StringType()), T.StructField("error", T.StringType())])

    def answers(asked: list[str]) -> list[tuple[str | None, str | None]]:
        try:
            return [(a, None) for a in model(asked)]
        except Exception as e:  # noqa: BLE001 - told in the row
            return [(None, str(e))] if len(asked) == 1 else [x for p in asked for x in answers([p])]

    def run(frames):
        for frame in frames:
            out = [x for at in range(0, len(frame), size) for x in answers(frame[prompt].iloc[at : at + size].tolist())]
            yield frame.assign(generated=[a for a, _ in out], error=[e for _, e in out])

    return prompts.mapInPandas(run, schema)


def scored(rows: DataFrame, scorer: Callable[[list[tuple]], Sequence[float]], columns: list[str], name: str = "score") -> DataFrame:
    """Rows with an outside metric's score of these columns; the system's score is its mean."""
    schema = T.StructType([*rows.schema.fields, T.StructField(name, T.DoubleType())])

    def run(frames):
        for frame in frames:
            asked = list(frame[columns].itertuples(index=False, name=None))
            yield frame.assign(**{name: [float(x) for x in scorer(asked)] if asked else []})

    return rows.mapInPandas(run, schema)


def tagged(rows: DataFrame, tagger: Callable[[str], Iterable[tuple[str, str]]] | None, text: str) -> DataFrame:
    """Rows with columns words and labels of an outside tagger; without one, words by white space and
    null labels, which ``metrics.labelled`` takes as all words."""
    if tagger is None:
        return rows.withColumn("words", F.split(F.trim(F.col(text)), r"\s+")).withColumn("labels", F.lit(None).cast("array<string>"))
    schema = T.StructType([*rows.schema.fields, T.StructField("words", T.ArrayType(T.StringType())), T.StructField("labels", T.ArrayType(T.StringType()))])

    def run(frames):
        for frame in frames:
            found = [list(tagger(t or "")) for t in frame[text]]
            yield frame.assign(words=[[w for w, _ in f] for f in found], labels=[[t for _, t in f] for f in found])

    return rows.mapInPandas(run, schema)


def analysed_or_guessed(words: DataFrame, analyser: Callable[[str], Iterable[str]], guesser: Callable[[str], Iterable[str]], word: str = "word", least: int = 2, most: int = 10) -> DataFrame:
    """Analyses of distinct words; those without any, and of ``least`` to ``most`` letters, have the
    guesser's, marked as guessed."""

    def both(w: str) -> list[str]:
        found = [*analyser(w)]
        return found or ([f"?{a}" for a in guesser(w)] if least <= len(w) <= most else [])

    made = analyse(words, both, word)
    guess = F.startswith("analysis", F.lit("?")) & ~F.startswith("analysis", F.lit("???"))
    return made.select(word, "pos", F.when(guess, F.substr("analysis", F.lit(2))).otherwise(F.col("analysis")).alias("analysis"), guess.alias("guessed"))


def segmented(words: DataFrame, segmenter: Callable[[str], Iterable[str]], word: str = "word") -> DataFrame:
    """(word, pos, analysis): the segmentations of distinct words that spell them."""
    return analyse(words, segmenter, word).where(keep_segmentation(F.col(word), F.col("analysis")))


def converted(rows: DataFrame, mapping: DataFrame, generator: Callable[[str], Iterable[str]]) -> DataFrame:
    """Analyses (surface, lemma, tags) under another tag set: mapping (tags, new_tags) is joined, and
    sound says whether the generator makes the surface of the new analysis again."""
    table, _ = broadcast_if_small(mapping)
    met = rows.join(table, "tags", "left").withColumn("analysis", F.concat("lemma", "new_tags"))
    made = analyse(met.where("analysis is not null").select(F.col("analysis").alias("word")), generator).groupBy("word").agg(F.collect_set("analysis").alias("surfaces"))
    out = met.join(made, F.col("word") == F.col("analysis"), "left")
    return out.select("surface", "lemma", "tags", "analysis", F.coalesce(F.array_contains("surfaces", F.col("surface")), F.lit(False)).alias("sound"))


def piped(lines: DataFrame, command: str, column: str = "line") -> DataFrame:
    """Lines that a command writes for the lines that it reads, partition by partition. A task runs one
    process and hands it whole batches; what it has written goes on after each, so a task holds no more
    than the process is behind. A command that fails fails the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        process = subprocess.Popen(shlex.split(command), stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        out: queue.SimpleQueue[bytes] = queue.SimpleQueue()

        def drain() -> None:
            while piece := process.stdout.read1(1 << 20):
                out.put(piece)

        reader = threading.Thread(target=drain, daemon=True)
        reader.start()
        left = b""

        def made(ended: bool = False) -> Iterator[pa.RecordBatch]:
            nonlocal left
            pieces = [left]
            while not out.empty():
                pieces.append(out.get())
            whole, mark, left = b"".join(pieces).rpartition(b"\n")
            if ended and left:
                whole, mark, left = whole + mark + left, b"\n", b""
            if mark:
                yield pa.RecordBatch.from_arrays([pa.array(whole.decode("utf-8", "replace").split("\n"), pa.string())], names=[column])

        try:
            for batch in batches:
                text = "".join(f"{line or ''}\n" for line in batch.column(0).to_pylist())
                try:
                    process.stdin.write(text.encode("utf-8", "surrogatepass"))
                except BrokenPipeError:  # it has read enough, or failed, which its status tells
                    break
                yield from made()
            with contextlib.suppress(BrokenPipeError):
                process.stdin.close()
            reader.join()
            yield from made(True)
            if process.wait():
                raise RuntimeError(f"{command}: ended with status {process.returncode}")
        finally:
            process.kill()

    return lines.select(F.col(column).cast("string").alias(column)).mapInArrow(run, f"`{column}` string")
