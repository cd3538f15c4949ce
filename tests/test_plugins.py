"""Front ends as data sources and the event sink."""

import glob
import os
import shutil

from factloom.sources import plugins as P


def test_two_front_ends_and_pruned_partitions(spark, tmp_path):
    def toml_pairs(file, text):
        for line in text.splitlines():
            if "=" in line:
                k, v = line.split("=", 1)
                yield "pair", {"key": k.strip(), "value": v.strip()}

    def todo_counts(file, text):
        yield "count", {"todo": text.count("TODO"), "file": file}

    for name, text in {"a/x.toml": "k = 1\nj = 2\n", "a/y.rs": "// TODO a TODO\n", "b/z.toml": "q = é\n", "b/c/w.rs": "fn f() {}\n", "n.txt": "k = 9"}.items():
        os.makedirs(tmp_path / os.path.dirname(name), exist_ok=True)
        (tmp_path / name).write_text(text)
    toml, todo = P.register(spark, P.FrontEnd("toml", (".toml",), toml_pairs)), P.register(spark, P.FrontEnd("todo", (".rs", ".toml"), todo_counts))
    load = lambda fmt: spark.read.format(fmt).option("root", f"file://{tmp_path}").option("bytes_per_partition", 1).load()
    assert sorted((r.file, r.what, r.ord, r.json) for r in load(toml).collect()) == [("a/x.toml", "pair", 0, '{"key": "k", "value": "1"}'), ("a/x.toml", "pair", 1, '{"key": "j", "value": "2"}'), ("b/z.toml", "pair", 0, '{"key": "q", "value": "\\u00e9"}')]
    whole = load(todo)
    assert whole.rdd.getNumPartitions() == 4 and whole.count() == 4
    below = load(todo).where("file LIKE 'b/%'")
    assert below.rdd.getNumPartitions() == 2 and sorted(r.file for r in below.collect()) == ["b/c/w.rs", "b/z.toml"]
    one = load(todo).where("file = 'a/y.rs' AND what = 'count'")
    assert one.rdd.getNumPartitions() == 1 and one.first().json == '{"todo": 2, "file": "a/y.rs"}'
    assert load(todo).where("file IN ('a/y.rs', 'none')").count() == 1
    assert load(todo).where("file = 'none'").count() == 0


def test_events_are_there_once_after_a_restart(spark, tmp_path):
    schema, feed, out, check = "event string, n long", str(tmp_path / "feed"), f"file://{tmp_path}/out", str(tmp_path / "check")
    sink = P.register_sink(spark)

    def run():
        spark.readStream.schema(schema).json(feed).writeStream.format(sink).option("path", out).option("checkpointLocation", check).trigger(availableNow=True).start().awaitTermination()

    seen = lambda: sorted((r.event, r.n, r.batch) for r in P.read_events(spark, out, schema).collect())
    spark.createDataFrame([("a", 1), ("b", 2)], schema).repartition(2).write.mode("append").json(feed)
    run()
    assert seen() == [("a", 1, 0), ("b", 2, 0)]
    spark.createDataFrame([("c", 3)], schema).write.mode("append").json(feed)
    run()
    want = [("a", 1, 0), ("b", 2, 0), ("c", 3, 1)]
    assert seen() == want
    for f in glob.glob(f"{check}/commits/*1*") + glob.glob(f"{check}/commits/.1*"):  # lost just before the query could note its batch
        os.remove(f)
    run()
    assert seen() == want and len(os.listdir(tmp_path / "out/data")) > 3
    shutil.copy(glob.glob(f"{tmp_path}/out/data/*.json")[0], f"{tmp_path}/out/data/never-committed.json")
    assert seen() == want
    w = P.EventWriter({"path": out})
    m = w.write(iter([]))
    w.abort([m, None], 9)
    assert not os.path.exists(f"{tmp_path}/out/{m.file}")
