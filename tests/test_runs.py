"""Layouts told by names, and runs that fail, are tried again and survive restarts."""

import fnmatch

import pytest

from scanweave.sources import formats
from scanweave.streaming import runs

TREE = {
    "lab/2024/run1": ["scan.h5", "scan_0001.tif", "scan_0002.tif", "images/"],
    "lab/2024/run2": ["scan.h5", "notes (old).txt", "images/"],
    "lab/2024": ["run1/", "run2/", "beamtime.yml"],
    "lab/2024/run1/images": ["a[1].tif"],
    "other": ["x.dat"],
}
RULES = [
    formats.Rule("stack", files=("*.h5", "*_????.tif"), folders=("images",)),
    formats.Rule("session", files=("*.h5",), around=("beamtime.y*", "run?")),
    formats.Rule("frames", only=("*.tif",), around=("beamtime.yml",)),
    formats.Rule("odd", files=("a[[]1].tif",)),
    formats.Rule("nothing"),
]


def reference(folder, rule):
    names = TREE[folder]
    files, folders = [n for n in names if not n.endswith("/")], [n[:-1] for n in names if n.endswith("/")]
    places = [folder]
    for _ in range(3):
        places.append(places[-1].rpartition("/")[0])
    held = []
    if rule.files:
        held.append(all(any(fnmatch.fnmatchcase(n, p) for n in files) for p in rule.files))
    if rule.folders:
        held.append(all(any(fnmatch.fnmatchcase(n, p) for n in folders) for p in rule.folders))
    if rule.around:
        held.append(any(all(any(fnmatch.fnmatchcase(n.rstrip("/"), p) for n in TREE.get(w, [])) for p in rule.around) for w in places))
    if rule.only:
        held.append(all(any(fnmatch.fnmatchcase(n, p) for p in rule.only) for n in files))
    return sum(held) / len(held)


def entries(spark):
    return spark.createDataFrame([(f, n.rstrip("/"), n.endswith("/")) for f, names in TREE.items() for n in names], "folder string, name string, is_folder boolean")


def test_scores_and_best_layouts(spark):
    got = {(r["folder"], r["rule"]): r["score"] for r in formats.scores(entries(spark), RULES).collect()}
    assert got == {(f, r.name): reference(f, r) for f in TREE for r in RULES[:-1]}
    best = {r["folder"]: r["rule"] for r in formats.best(entries(spark), RULES).collect()}
    assert best == {"lab/2024/run1": "stack", "lab/2024/run2": "session", "lab/2024": None, "lab/2024/run1/images": "frames", "other": None}
    assert formats.scores(entries(spark).limit(0), RULES).collect() == []
    with pytest.raises(ValueError, match="same name"):
        formats.scores(entries(spark), [RULES[0], RULES[0]])


@pytest.fixture
def work():
    """A function inside a function travels to the tasks whole; they can't import this module."""

    def summed(rows):
        if rows["v"].min() < 0:
            raise RuntimeError("no beam")
        return str(int(rows["v"].sum()))

    return summed


def test_attempts_and_errors_of_one_run_leave_the_others_alone(spark, work):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", -1), ("c", 5)], "run string, v long")
    got = {r["run"]: tuple(r)[1:] for r in runs.attempted(rows, "run", work, retries=2).collect()}
    assert got == {"a": ("ok", 1, "3", None), "b": ("failed", 3, None, "RuntimeError: no beam"), "c": ("ok", 1, "5", None)}
    assert runs.attempted(rows.limit(0), "run", work).collect() == []


def test_watcher_with_a_failing_run_a_retry_and_a_restart(spark, tmp_path, work):
    raw, calls = tmp_path / "raw", tmp_path / "calls"
    calls.mkdir()

    def counted(rows):
        name = rows["run"].iloc[0]
        (calls / name).write_text((calls / name).read_text() + "x" if (calls / name).exists() else "x")
        return work(rows)

    def arrive(name, values):
        spark.createDataFrame([(name, v) for v in values], "run string, v long").coalesce(1).write.mode("append").parquet(str(raw))

    def watch(checkpoint="state"):
        stream = spark.readStream.schema("run string, v long").option("maxFilesPerTrigger", 1).parquet(str(raw))
        runs.watch_runs(stream, ledger, counted, str(tmp_path / checkpoint), retries=1).awaitTermination()

    def tried():
        return {p.name: len(p.read_text()) for p in calls.iterdir()}

    ledger = runs.Ledger(spark, f"file://{tmp_path}/ledger", "run")
    assert ledger.records().count() == 0
    arrive("r1", [1, 2])
    arrive("r2", [-1])
    watch()
    arrive("r3", [4])
    watch()  # a restart: what was done is not done again
    assert tried() == {"r1": 1, "r2": 2, "r3": 1}
    assert {r["run"]: (r["status"], r["attempts"], r["output"]) for r in ledger.records().collect()} == {"r1": ("ok", 1, "3"), "r2": ("failed", 2, None), "r3": ("ok", 1, "4")}
    assert [r["run"] for r in ledger.skip_list().collect()] == ["r2"]
    watch("lost state")  # the stream starts anew, from the first batch on; the ledger still knows
    assert tried() == {"r1": 1, "r2": 2, "r3": 1}
    ledger.forgive(["r2"], 1000)
    rows = spark.createDataFrame([("r2", 9), ("r1", 1), ("r9", 2)], "run string, v long")
    ledger.process(rows, 1001, counted, only=["r1", "r2"])
    assert tried() == {"r1": 1, "r2": 3, "r3": 1} and ledger.skip_list().count() == 0
    ledger.process(rows, 1001, counted)  # the same batch once more
    assert "r9" not in tried()
    ledger.process(rows, 1002, counted)
    assert tried()["r9"] == 1
    with pytest.raises(ValueError, match="recorded"):
        ledger.forgive(["r2"], 1000)
