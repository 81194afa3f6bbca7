import os

import pytest

from helpers import values
from packloom import ScanConfig
from packloom.plans.packing import Run
from packloom.streaming import arrivals as streaming
from packloom.streaming.arrivals import Arrivals, frame_arrivals

FILES = {"z.txt": "last", "a-b/x.txt": "one\ntwo\n", "a/b.txt": "", "a.txt": "</file>\r\n", ".hidden": "h", "no.pem": "secret", "big": "x" * 3000}
CONFIG = ScanConfig(exclude="a/", max_size=2)


def test_arriving_files(spark, entries, tmp_path):
    source, table = str(tmp_path / "in"), entries(FILES)
    table.write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    config = ScanConfig(exclude="a/")
    query = frame_arrivals(stream, config).writeStream.format("memory").queryName("arrived").option(
        "checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    got = values(spark.table("arrived"), "rel_path", "value")
    packed = Run(table, config).pack().where("section = 1")
    assert {value for _, value in got} == values(packed, "value") and len(got) == 5


def stream_of(spark, table, folder):
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def same_as_batch(done, table):
    run = Run(table, CONFIG)
    assert values(done.blocks(), "value") == values(run.pack().where("section = 1"), "value")
    stats = run.token_rollup().where("level = 7")
    assert values(done.counts(), "project", "block_tokens") == values(stats, "project", "block_tokens")
    assert values(done.counts(), "files_processed", "files_skipped") == values(run.stats(), "files_processed", "files_skipped")


def test_a_stream_equals_the_batch_also_after_a_restart(spark, entries, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    first = entries({p: FILES[p] for p in list(FILES)[:3]})
    first.repartition(2, "rel_path").write.parquet(source)
    Arrivals(spark, out, CONFIG).start(stream_of(spark, first, source)).awaitTermination()
    same_as_batch(Arrivals(spark, out, CONFIG), first)
    rest = entries({p: FILES[p] for p in list(FILES)[3:]})
    rest.coalesce(1).write.mode("append").parquet(source)
    done = Arrivals(spark, out, CONFIG)
    done.start(stream_of(spark, first, source)).awaitTermination()
    same_as_batch(done, entries(FILES))
    # Nothing new: nothing is counted again.
    done.start(stream_of(spark, first, source)).awaitTermination()
    same_as_batch(done, entries(FILES))


def test_a_batch_that_fails_half_way_is_not_counted_twice(spark, entries, tmp_path, monkeypatch):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    table = entries(FILES)
    table.coalesce(1).write.parquet(source)

    def broken(*_):
        raise RuntimeError("lost while counting")

    monkeypatch.setattr(streaming, "count_files", broken)
    with pytest.raises(Exception, match="lost while counting"):
        Arrivals(spark, out, CONFIG).start(stream_of(spark, table, source)).awaitTermination()
    assert os.listdir(os.path.join(out, "files"))  # its files were written before it failed
    monkeypatch.undo()
    done = Arrivals(spark, out, CONFIG)
    done.start(stream_of(spark, table, source)).awaitTermination()
    same_as_batch(done, table)
