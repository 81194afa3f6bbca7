"""Language identification by compression.

Each language has a dictionary of raw text.  A text, lower-cased and reduced to its letters and the
gaps between them, is cut into segments; each is compressed with every language's dictionary by
zstandard, and the language with the fewest bytes wins.  A small margin between the two smallest
marks the decision as ``rejected``.  Every value of ``lang`` is learned; many languages are judged
in groups, whose sizes are put side by side.

Null texts and texts without a letter are ``und`` with score 0, as are all texts if no language
was learned.  Equal sizes go to the language that sorts first.  Repeated rows are judged each;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packloom.llm.common import written

#: Bounds of the dictionaries: documents and bytes per language, bytes of all.
SAMPLE_DOCS = 400
DICTIONARY_BYTES = 64 * 1024
ALL_BYTES = 32 * 1024 * 1024
#: Languages whose compressors a worker holds at a time, and sizes it holds while it goes through the groups.
GROUP = 500
SIZES = 8_000_000
#: Characters a sampled document gives at most, from a place its hash picks.
SNIPPET = 400
SEGMENT = 4096
#: Compression level of all texts.
LEVEL = 12
MIN_MARGIN = 0.01
GAP = re.compile(r"[\W\d_]+")


def reduced(text: str) -> str:
    return GAP.sub(" ", text.lower())


def sample_texts(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang, snippet`` of up to ``SAMPLE_DOCS`` documents per language, those whose hashes are smallest.

    Counts by language say below which hash enough documents are to be found, so only a few times
    ``SAMPLE_DOCS`` snippets per language leave their scan.
    """
    rows = docs.where(learn & F.col(lang).isNotNull() & (F.length(text) > 0))
    counts = written(rows.groupBy(F.col(lang).alias("_lang")).agg(F.count(F.lit(1)).alias("_count")))
    wanted = max(1, min(SAMPLE_DOCS, ALL_BYTES // (SNIPPET * max(1, counts.count()))))
    order = F.xxhash64(F.col(doc_id).cast("string"), F.col(text))
    rows = rows.join(F.broadcast(counts), F.col(lang) == F.col("_lang"))
    share = F.least(F.lit(1.0), F.lit(4.0 * wanted + 40) / F.col("_count"))
    start = F.pmod(order, F.greatest(F.length(text) - SNIPPET, F.lit(1))).cast("int")
    near = rows.where(F.pmod(order, F.lit(2**40)) / F.lit(float(2**40)) < share).select(
        F.col(lang).alias("lang"), F.pmod(order, F.lit(2**40)).alias("_order"),
        F.substring(F.col(text), start + 1, F.lit(SNIPPET)).alias("snippet"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("_order", "snippet"))
    return near.withColumn("_rank", rank).where(F.col("_rank") <= wanted).select("lang", "_order", "snippet")


def train_languages(docs: DataFrame, learn: Column, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, bytes]:
    """A raw-content dictionary per language, of ``DICTIONARY_BYTES`` or an equal share of ``ALL_BYTES``.

    Lines that the samples of several languages share tell none of them apart and are left out.
    """
    sample = sample_texts(docs, learn, doc_id, text, lang).orderBy("lang", "_order", "snippet").toPandas()
    seen = defaultdict(set)
    for name, snippet in zip(sample["lang"], sample["snippet"], strict=True):
        for line in snippet.split("\n"):
            seen[line.strip()].add(name)
    lines = defaultdict(list)
    for name, snippet in zip(sample["lang"], sample["snippet"], strict=True):
        lines[name] += [x for x in snippet.split("\n") if len(seen[x.strip()]) == 1]
    size = min(DICTIONARY_BYTES, ALL_BYTES // max(1, sample["lang"].nunique()))
    return {name: reduced(" ".join(lines[name])).encode()[-size:] for name in sorted(set(sample["lang"]))}


class Compressors:
    def __init__(self, dictionaries: dict[str, bytes]):
        import zstandard

        def compressor(content: bytes):
            shared = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(content) >= 8 else None
            if shared:
                shared.precompute_compress(level=LEVEL)
            return zstandard.ZstdCompressor(
                level=LEVEL, dict_data=shared, write_content_size=False, write_checksum=False, write_dict_id=False).compress

        self.names = sorted(dictionaries)
        self.tools = [compressor(dictionaries[n]) for n in self.names]

    def sizes(self, content: bytes) -> list[int]:
        """Bytes of a reduced text with each dictionary, in the order of names."""
        segments = [content[at : at + SEGMENT] for at in range(0, len(content), SEGMENT)]
        return [sum([len(compress(s)) for s in segments]) for compress in self.tools]


class Judge:
    """Compares texts with all dictionaries, ``GROUP`` of them at a time; a single group's compressors are kept."""

    def __init__(self, dictionaries: dict[str, bytes]):
        self.names = sorted(dictionaries)
        self.groups = [{n: dictionaries[n] for n in self.names[at : at + GROUP]} for at in range(0, len(self.names), GROUP)]
        self.kept = Compressors(self.groups[0]) if len(self.groups) == 1 else None

    def all(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        at_once = max(1, SIZES // max(1, len(self.names)))
        return [found for at in range(0, len(texts), at_once) for found in self._some(texts[at : at + at_once])]

    def _some(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        found = [("und", 0.0, 0.0)] * len(texts)
        judged = [i for i, t in enumerate(texts) if t and self.names and any(c.isalpha() for c in t)]
        if not judged:
            return found
        sizes, at = np.empty((len(judged), len(self.names))), 0
        for group in self.groups:
            tools = self.kept or Compressors(group)
            for row, i in enumerate(judged):
                sizes[row, at : at + len(group)] = tools.sizes(reduced(texts[i]).encode())
            at += len(group)
        for row, i in enumerate(judged):
            found[i] = self.decide(sizes[row])
        return found

    def decide(self, sizes: np.ndarray) -> tuple[str, float, float]:
        """Language, score and margin: how much more than the fewest bytes the runner-up needs, relative to its own."""
        best = int(sizes.argmin())
        others = np.delete(sizes, best)
        if not len(others):
            return self.names[best], 1.0, 1.0
        margin = float((others.min() - sizes[best]) / others.min())
        shares = np.exp(-100 * (sizes - sizes[best]) / sizes[best])
        return self.names[best], float(1 / shares.sum()), margin


def identify(docs: DataFrame, dictionaries: dict[str, bytes], held_out: Column, doc_id: str = "doc_id", text: str = "text",
             min_margin: float = MIN_MARGIN) -> DataFrame:
    """``doc_id, held_out, lang_pred, score, margin, rejected`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judged = Judge(sent.value)
        for batch in batches:
            found = judged.all(batch.column(2).to_pylist())
            names, scores, margins = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(margins, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score", "margin"])

    rows = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), held_out.alias("held_out"), F.col(text).alias("text"))
    judged = rows.mapInArrow(judge, "doc_id bigint, held_out boolean, lang_pred string, score double, margin double")
    return judged.withColumn("rejected", F.col("margin") < min_margin)
