from __future__ import annotations

import os
import random
import time

import pandas as pd
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from codecorpus.sources import files as fl
from codecorpus.sources import listing, sinks, versions
from codecorpus.streaming import arrivals


def write(root, **texts):
    for name, text in texts.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(text, encoding="utf8")


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    write(root, **{
        "a.js": "one\ntwo", "b.mjs": "b", "c.cjs": "", "d.txt": "no", "E.JS": "upper",
        "lib/f.js": "éü", "lib/deep/g.js": "g", "node_modules/p/h.js": "h",
        "lib/node_modules/p/i.js": "i", "dist/j.js": "j", "lib/k.ts": "k",
        "_app.js": "under", "lib/__tests__/l.js": "test", "lib/.hidden.js": "no", ".git/m.js": "no",
    })
    return str(root)


def names(df, root):
    return sorted(r.path.split("/tree/", 1)[1] for r in df.select("path").collect())


def test_one_file_is_read_whole_with_its_size_in_bytes(spark, tree):
    row = fl.read_file(spark, f"{tree}/lib/f.js").first()
    assert (row.code, row.n_bytes) == ("éü", 4)
    row = fl.read_file(spark, f"{tree}/a.js").first()
    assert (row.code, row.n_bytes) == ("one\ntwo", 7)
    assert [(r.code, r.n_bytes) for r in fl.read_file(spark, f"{tree}/c.cjs").collect()] == [("", 0)]
    assert [r.code for r in fl.read_file(spark, f"{tree}/_app.js").collect()] == ["under"]


def test_recursive_scan_skips_excluded_folders_at_any_depth(spark, tree):
    got = names(fl.scan_folder(spark, tree), tree)
    assert got == ["_app.js", "a.js", "b.mjs", "c.cjs", "lib/__tests__/l.js", "lib/deep/g.js",
                   "lib/f.js"]
    codes = {r.path.rsplit("/", 1)[1]: (r.code, r.n_bytes)
             for r in fl.scan_folder(spark, tree).collect()}
    assert codes["_app.js"] == ("under", 5) and codes["c.cjs"] == ("", 0)
    assert codes["l.js"] == ("test", 4) and codes["f.js"] == ("éü", 4)


def test_flat_scan_pattern_and_exclude(spark, tree):
    assert names(fl.scan_folder(spark, tree, recursive=False), tree) == [
        "_app.js", "a.js", "b.mjs", "c.cjs"]
    assert names(fl.scan_folder(spark, tree, patterns=["lib/**/*.js"]), tree) == [
        "lib/__tests__/l.js", "lib/deep/g.js", "lib/f.js"]
    assert names(fl.scan_folder(spark, tree, exclude=["!lib/**"]), tree) == [
        "_app.js", "a.js", "b.mjs", "c.cjs"]
    assert names(fl.scan_folder(spark, tree, patterns=["*.txt", "E.*"]), tree) == ["E.JS"]


def test_scan_prunes_files_by_path_before_opening_them(spark, tree, monkeypatch):
    scan = fl.scan_folder(spark, tree, patterns=["lib/*.js"])
    text = scan._jdf.queryExecution().executedPlan().toString()
    assert "RLIKE" in text.split("MapInPandas")[1]  # below the step that opens files


def walked(root):
    return sorted(os.path.relpath(os.path.join(d, f), root) for d, _, files in os.walk(root) for f in files)


@pytest.mark.parametrize("page", [1, 3, 5000])
def test_listing_equals_a_walk(spark, tmp_path, page):
    root = tmp_path / "deep"
    at = root
    for k in range(12):
        at = at / f"d{k}"
        write(at, **{f"f{i}.js": "x" * i for i in range(k % 4)}, **{f"side{k}/_g.js": "", f"side{k}/h": "1"})
    (root / "empty").mkdir()
    (root / "link").symlink_to(root / "d0")
    rows = listing.list_files(spark, str(root), page=page).collect()
    assert sorted(r.rel for r in rows) == walked(root)
    assert all(r.n_bytes == os.path.getsize(root / r.rel) and r.path == f"file://{root}/{r.rel}" for r in rows)
    assert all(abs(r.modified.timestamp() - os.path.getmtime(root / r.rel)) < 1 for r in rows)


def test_flat_folder_comes_in_pages(spark, tmp_path):
    for i in range(20_000):
        (tmp_path / f"{i}.js").touch()
    step = listing._lister(str(tmp_path), True, frozenset(), 1000)
    sizes = [len(f) for f in step(iter([pd.DataFrame({"rel": [""]})]))]
    assert sum(sizes) == 20_000 and max(sizes) == 1000
    assert listing.list_files(spark, str(tmp_path)).count() == 20_000


def test_folders_beyond_a_page_are_handed_on(tmp_path):
    write(tmp_path, **{f"d{i}/f{j}": "" for i in range(9) for j in range(5)})
    first = pd.concat(listing._lister(str(tmp_path), True, frozenset(), 12)(iter([pd.DataFrame({"rel": [""]})])))
    assert 0 < first["folder"].sum() < 9 and (~first["folder"]).sum() == 5 * (9 - first["folder"].sum())


def test_missing_root_and_odd_roots(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        listing.list_files(spark, str(tmp_path / "none"))
    assert listing.list_files(spark, str(tmp_path)).count() == 0
    write(tmp_path, **{"a b%20.js": "1"})
    for root in (str(tmp_path), f"file://{tmp_path}", f"file:{tmp_path}/", f"{tmp_path}//"):
        assert [(r.rel, r.path) for r in listing.list_files(spark, root).collect()] == [("a b%20.js", f"file://{tmp_path}/a b%20.js")]
    assert [r.code for r in listing.read_files(listing.list_files(spark, str(tmp_path))).collect()] == ["1"]


@pytest.mark.parametrize("uri,opened", [
    ("s3a://bucket/x/y", "s3://bucket/x/y"), ("s3n://b/x", "s3://b/x"), ("gs://b/x", "gs://b/x"), ("hdfs://h:1/x", "hdfs://h:1/x"),
    ("viewfs://cluster/a/b", ("viewfs://cluster", "/a/b")), ("viewfs:///a/b", ("default", "/a/b")), ("/tmp/x", None), ("file:/tmp/x", None)])
def test_schemes(monkeypatch, uri, opened):
    seen = []
    monkeypatch.setattr(listing.pafs, "FileSystem", type("F", (), {"from_uri": staticmethod(lambda u: seen.append(u) or (None, ""))}))
    monkeypatch.setattr(listing.pafs, "HadoopFileSystem", lambda host, port: seen.append(host))
    inner = listing.open_filesystem(uri)[1]
    assert (seen[0] if isinstance(opened, str) else (seen[0], inner) if opened else None) == opened
    assert opened or inner == "/tmp/x"


@pytest.mark.parametrize("pattern,path,hit", [
    ("**/*.js", "a.js", True), ("**/*.js", "x/y/a.js", True), ("*.js", "x/a.js", False),
    ("src/**", "src/a/b.js", True), ("?.js", "a.js", True), ("?.js", "ab.js", False),
    ("*.{js,mjs}", "a.mjs", True), ("[!ab].js", "c.js", True), ("[!ab].js", "a.js", False),
    ("a+b.js", "a+b.js", True), ("a+b.js", "aab.js", False),
])
def test_glob(spark, pattern, path, hit):
    row = spark.range(1).select(fl.matches_any(F.lit(path), [pattern]).alias("m")).first()
    assert row.m is hit


def test_output_paths(spark):
    df = spark.createDataFrame([("/w/src/a.b.js",), ("/w/.rc",), ("/w/plain",)], "path string")
    rows = df.select(
        fl.output_path(F.col("path"), "/out", root="/w").alias("tree"),
        fl.output_path(F.col("path"), "/out/", keep_tree=False).alias("flat"),
        fl.output_path(F.col("path")).alias("beside")).collect()
    assert tuple(rows[0]) == ("/out/src/a.b.js", "/out/a.b.js", "/w/src/a.b.readable.js")
    assert rows[1].beside == "/w/.rc.readable"
    assert rows[2].beside == "/w/plain.readable"


def test_preview_counts_and_lists_first_paths(spark):
    df = spark.createDataFrame([(f"f{i}.js",) for i in range(9, 0, -1)], "path string")
    rows = [(r.item, r.value) for r in fl.preview(df, 5).collect()]
    assert rows == [("files", "9")] + [("path", f"f{i}.js") for i in range(1, 6)]
    assert fl.preview(df).filter("item = 'path'").count() == 9


def test_sink_refuses_to_overwrite_unless_forced(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_table(spark.range(3), path)
    with pytest.raises(AnalysisException):
        sinks.write_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 3
    sinks.write_table(spark.range(5), path, force=True)
    assert spark.read.parquet(path).count() == 5


def test_rewrite_keeps_the_old_version(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(4).write.parquet(path)
    backup = sinks.rewrite_with_backup(
        spark, path, str(tmp_path / "old"), "r1", lambda df: df.select((F.col("id") * 10).alias("id")))
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 10, 20, 30]
    assert sorted(r.id for r in spark.read.parquet(backup).collect()) == [0, 1, 2, 3]
    with pytest.raises(AnalysisException):
        sinks.rewrite_with_backup(spark, path, str(tmp_path / "old"), "r1", lambda df: df)
    assert spark.read.parquet(path).count() == 4


def test_watch_processes_each_file_once(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write(root, **{"a.js": "x;y", "sub/b.mjs": "z", "c.txt": "no"})

    def run():
        q = arrivals.watch_files(
            spark, str(root), out, check, lambda df: df.withColumn("code", F.upper("code")))
        assert q.awaitTermination(120)
        return sorted((r.path.rsplit("/", 1)[1], r.code) for r in spark.read.parquet(out).collect())

    assert run() == [("a.js", "X;Y"), ("b.mjs", "Z")]
    assert run() == [("a.js", "X;Y"), ("b.mjs", "Z")]
    write(root, **{"sub/d.cjs": "new"})
    assert run() == [("a.js", "X;Y"), ("b.mjs", "Z"), ("d.cjs", "NEW")]


def test_empty_and_underscored_files_arrive_and_changed_ones_again(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write(root, **{"_a.js": "1", "e.js": "", "__tests__/b.js": "2", ".c.js": "no", "node_modules/d.js": "no"})

    def run(**more):
        assert arrivals.watch_files(spark, str(root), out, check, lambda df: df, **more).awaitTermination(120)
        return sorted((r.path.split("/in/")[1], r.code) for r in spark.read.parquet(out).collect())

    first = [("__tests__/b.js", "2"), ("_a.js", "1"), ("e.js", "")]
    assert run() == first
    assert run() == first  # a restart repeats nothing
    old = tmp_path / "moved.js"
    old.write_text("old")
    os.utime(old, (1, 1))  # a file that arrives late with an old time
    old.rename(root / "moved.js")
    assert run() == sorted([*first, ("moved.js", "old")])
    time.sleep(0.01)
    write(root, **{"e.js": "now"})
    assert run() == sorted([*first, ("moved.js", "old"), ("e.js", "now")])


def test_batches_of_files_are_bounded(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write(root, **{f"{i}.js": str(i) for i in range(25)})
    sizes = []

    def change(df):
        sizes.append(df.count())
        return df
    assert arrivals.watch_files(spark, str(root), out, check, change, max_files=10).awaitTermination(120)
    assert sum(sizes) == 25 and max(sizes) <= 10


def test_by_default_a_batch_has_files_for_each_of_its_tasks(spark, tmp_path, monkeypatch):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write(root, **{f"{i}.js": str(i) for i in range(60)})
    assert arrivals.batch_files(spark) == 1000 * 8
    monkeypatch.setattr(arrivals, "TASK_FILES", 4)
    sizes = []

    def change(df):
        sizes.append(df.count())
        return df
    assert arrivals.watch_files(spark, str(root), out, check, change).awaitTermination(120)
    assert sum(sizes) == 60 and len(sizes) <= 3 and max(sizes) <= 32


def test_a_log_half_written_is_taken_up_again(spark, tmp_path):
    root, log = tmp_path / "in", str(tmp_path / "log")
    write(root, **{f"{i}.js": str(i) for i in range(9)})
    rows = fl.chosen_files(spark, str(root)).orderBy("path")
    rows.limit(4).select("path", "rel", "n_bytes", "modified").write.parquet(log)
    assert arrivals.discover(spark, str(root), log) == 5 and arrivals.discover(spark, str(root), log) == 0
    assert spark.read.parquet(log).select("path").distinct().count() == spark.read.parquet(log).count() == 9


def test_watching_goes_on_until_it_is_stopped(spark, tmp_path):
    root, out, check = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "cp")
    write(root, **{"a.js": "1"})
    q = arrivals.watch_files(spark, str(root), out, check, lambda df: df, available_now=False, every="1 second")
    try:
        for text in ("1", "2"):
            write(root, **{f"{text}.js": text})
            for _ in range(120):
                time.sleep(0.5)
                if os.path.isdir(out) and spark.read.parquet(out).filter(F.col("path").endswith(f"/{text}.js")).count():
                    break
            else:
                raise AssertionError("the file never came out")
    finally:
        q.stop()
    assert sorted(r.code for r in spark.read.parquet(out).collect()) == ["1", "1", "2"]


def test_repeated_keys_pass_once_within_their_time_to_live(spark, tmp_path):
    src, out, check = (str(tmp_path / d) for d in ("src", "out", "cp"))

    def batch(*rows):
        df = spark.createDataFrame(rows, "key string, at string")
        df.select("key", F.to_timestamp_ntz("at").alias("ts")).coalesce(1).write.mode(
            "append").parquet(src)
        stream = spark.readStream.schema("key string, ts timestamp_ntz").parquet(src)
        q = (arrivals.first_in_ttl(stream, 60).writeStream.format("parquet")
             .option("checkpointLocation", check).option("path", out)
             .trigger(availableNow=True).start())
        assert q.awaitTermination(120)
        return sorted((r.key, str(r.ts)[11:]) for r in spark.read.parquet(out).collect())

    assert batch(("a", "2024-01-01 00:00:00"), ("b", "2024-01-01 00:00:10")) == [
        ("a", "00:00:00"), ("b", "00:00:10")]
    # a repeat inside the time to live is dropped
    assert len(batch(("a", "2024-01-01 00:00:30"))) == 2
    # far later, with the watermark past the first entry, the key is new again
    assert len(batch(("c", "2024-01-01 01:00:00"))) == 3
    assert len(batch(("a", "2024-01-01 01:00:10"))) == 4


def test_keys_pass_again_after_their_time_to_live_within_a_batch(spark, tmp_path):
    src, out, check = (str(tmp_path / d) for d in ("src", "out", "cp"))
    rows = [("a", f"2024-01-01 00:{m:02d}:{s:02d}") for m, s in ((0, 0), (0, 9), (8, 20), (8, 29), (16, 40))]
    spark.createDataFrame(rows, "key string, at string").select(
        "key", F.to_timestamp_ntz("at").alias("ts")).coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("key string, ts timestamp_ntz").parquet(src)
    q = (arrivals.first_in_ttl(stream, 10).writeStream.format("parquet").option("checkpointLocation", check)
         .option("path", out).trigger(availableNow=True).start())
    assert q.awaitTermination(120)
    assert sorted(str(r.ts)[14:] for r in spark.read.parquet(out).collect()) == ["00:00", "08:20", "16:40"]


def first_of(rows, ttl):
    out, last = [], {}
    for key, t in sorted(set(rows), key=lambda r: r[1]):
        if key not in last or t >= last[key] + ttl:
            last[key] = t
            out.append((key, t))
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_batches_out_of_order_give_what_one_batch_gives(spark, tmp_path, seed):
    src, out, check = (str(tmp_path / d) for d in ("src", "out", "cp"))
    rng = random.Random(seed)
    rows = sorted((rng.choice("abcd"), rng.randrange(0, 4000)) for _ in range(300))
    rows.sort(key=lambda r: r[1] + rng.randrange(0, 600))  # up to ten minutes late

    def send(batch):
        spark.createDataFrame(batch, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts")).coalesce(1) \
            .write.mode("append").parquet(src)

    def run():
        stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
        q = (arrivals.first_in_ttl(stream, 300, lateness="10 minutes").writeStream.format("parquet")
             .option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start())
        assert q.awaitTermination(180)
        return q
    for i in range(0, 300, 75):
        send(rows[i:i + 75])
    send([("end", 100_000)])
    assert arrivals.late_rows(run()) == 0
    got = sorted((r.key, int(r.ts.timestamp())) for r in spark.read.parquet(out).collect())
    assert got == first_of(rows, 300)
    send([("a", 1), ("new", 2)])  # far too late: dropped, and counted
    assert arrivals.late_rows(run()) == 2 and spark.read.parquet(out).filter("key = 'new'").count() == 0


def test_many_keys_share_rows_of_state(spark, tmp_path):
    src, out, check = (str(tmp_path / d) for d in ("src", "out", "cp"))
    rng = random.Random(5)
    rows = [(rng.choice([None, *(f"k{i}" for i in range(1500))]), rng.randrange(5000, 6000)) for _ in range(4000)]
    for part in (rows[:2000], rows[2000:], [("end", 20_000)]):
        spark.createDataFrame(part, "key string, s long").select("key", F.timestamp_seconds("s").alias("ts")).coalesce(1) \
            .write.mode("append").parquet(src)
    stream = spark.readStream.schema("key string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(src)
    q = (arrivals.first_in_ttl(stream, 200, lateness="20 minutes").writeStream.format("parquet")
         .option("checkpointLocation", check).option("path", out).trigger(availableNow=True).start())
    assert q.awaitTermination(180)
    got = [(r.key, int(r.ts.timestamp())) for r in spark.read.parquet(out).collect()]
    want = first_of([(k or "", t) for k, t in rows], 200)
    assert sorted((k or "", t) for k, t in got) == want and (None in {k for k, _ in got})
    held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= arrivals.KEY_GROUPS  # and not a row, and a call, for each key


def test_another_checkpoint_leaves_earlier_output(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    write(root, **{"a.js": "x", "skip.js": "y"})
    for name, exclude in (("one", []), ("two", ["skip.js"])):
        q = arrivals.watch_files(spark, str(root), out, str(tmp_path / name), lambda df: df, exclude=exclude)
        assert q.awaitTermination(120)
    assert sorted(r.code for r in spark.read.parquet(out).collect()) == ["x", "x", "y"]


def test_files_are_written_once_and_not_overwritten(spark, tmp_path):
    root = str(tmp_path / "w")

    def put(text, force=False):
        df = spark.createDataFrame([(f"{root}/x/a.js", text), (f"{root}/b.js", "same")],
                                   "path string, code string")
        return {r.path.rsplit("/", 1)[1]: (r.written, r.error_code)
                for r in sinks.write_files(df, force).collect()}

    assert put("é") == {"a.js": (True, None), "b.js": (True, None)}
    # a repeated task finds its own output
    assert put("é") == {"a.js": (True, None), "b.js": (True, None)}
    assert put("new") == {"a.js": (False, "FILE_WRITE_ERROR"), "b.js": (True, None)}
    assert (tmp_path / "w/x/a.js").read_text(encoding="utf8") == "é"
    assert put("new", force=True)["a.js"] == (True, None)
    assert (tmp_path / "w/x/a.js").read_text() == "new"
    assert sorted(p.name for p in (tmp_path / "w").rglob("*.*")) == ["a.js", "b.js"]


def test_rows_without_path_or_text_are_error_rows(spark, tmp_path):
    rows = [(f"{tmp_path}/a.js", None), (None, "x"), ("", "x"), (f"{tmp_path}/b.js", "")]
    got = sinks.write_files(spark.createDataFrame(rows, "path string, code string")).collect()
    assert [(r.written, r.error_code) for r in got] == [(False, "INVALID_INPUT")] * 3 + [(True, None)]
    assert [p.name for p in tmp_path.iterdir()] == ["b.js"]


def test_versions_are_switched_whole(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, root)
    assert versions.publish(spark.range(4), root) == 1

    def failing(df):
        return df.select(F.when(F.col("id") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("id")).cast("long").alias("id"))
    with pytest.raises(Exception, match="lost"):
        versions.revise(spark, root, failing)  # fails in the middle of a write
    assert sorted(r.id for r in versions.read_version(spark, root).collect()) == [0, 1, 2, 3]
    reader = versions.read_version(spark, root)
    assert versions.revise(spark, root, lambda df: df.select((F.col("id") * 10).alias("id"))) == 2
    assert sorted(r.id for r in reader.collect()) == [0, 1, 2, 3]  # a reader keeps the version it opened
    assert sorted(r.id for r in versions.read_version(spark, root).collect()) == [0, 10, 20, 30]
    assert sorted(r.id for r in versions.read_version(spark, root, 1).collect()) == [0, 1, 2, 3]
    with pytest.raises(FileNotFoundError):
        versions.read_version(spark, root, 9)


def test_a_switch_that_fails_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    versions.publish(spark.range(2), root)
    monkeypatch.setattr(versions.uuid, "uuid4", lambda: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        versions.publish(spark.range(9), root)
    assert versions.read_version(spark, root).count() == 2
