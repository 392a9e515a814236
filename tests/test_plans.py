import hashlib
import json
import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from spendlake import schemas, staging
from spendlake.plans import ask
from spendlake.plans.embed import embed_pending
from spendlake.plans.imports import import_messages
from spendlake.plans.ledger import build_ledger
from spendlake.sources import landing, tables
from spendlake.streaming.landing import import_landed
from tests.conftest import TODAY
from tests.test_messages import PLAIN, coded


def message(own_id, text):
    return json.dumps({"id": own_id, "raw": coded(PLAIN + text)})


@pytest.fixture
def folder(tmp_path):
    path = tmp_path / "landing"
    path.mkdir()
    files = {
        "a.json": message("1", "one " * 20),
        "b.json": message("2", "one " * 20),
        "c.json": message("1", "another"),
        "d.json": message("4", "receipt total " * 10),
        "e.json": "{broken",
        "f.txt": message("6", "not a json file"),
    }
    for name, text in files.items():
        (path / name).write_text(text)
    (path / "g.json").write_bytes(b'{"id":"\xff"}')
    return str(path)


@pytest.fixture
def paths(spark, tmp_path):
    made = {name: str(tmp_path / name) for name in ("emails", "embeddings", "tx")}
    tables.create_tables(spark, **made)
    tables.create_tables(spark, **made)
    return made


def accepted_ids(folder):
    """Ids of the four readable messages that are new, offered by the hash of their path."""
    keys = {"a": ("1", "one"), "b": ("2", "one"), "c": ("1", "another"), "d": ("4", "receipt")}

    def offered(name):
        path = f"file:{folder}/{name}.json"
        return hashlib.sha256(path.encode()).hexdigest() + path

    ids, bodies = [], []
    for name in sorted(keys, key=offered):
        own_id, body = keys[name]
        if own_id not in ids and body not in bodies:
            ids.append(own_id)
            bodies.append(body)
    return sorted(ids)


def test_import_twice(spark, folder, paths):
    ids = accepted_ids(folder)
    for expected in [(len(ids), 4 - len(ids), 2), (0, 4, 2)]:
        new, summary = import_messages(
            landing.scan_messages(spark, folder), tables.read_emails(spark, paths["emails"]), TODAY
        )
        assert tuple(summary.first()) == expected
        tables.append_emails(new, paths["emails"])
    stored = tables.read_emails(spark, paths["emails"])
    assert sorted(r.id for r in stored.collect()) == ids


def test_compacted_messages_import_the_same(spark, folder, paths, tmp_path):
    path = str(tmp_path / "compact")
    landing.compact(landing.scan_messages(spark, folder), path)
    emails = tables.read_emails(spark, paths["emails"])
    new, _ = import_messages(spark.read.parquet(path), emails, TODAY)
    assert sorted(r.id for r in new.collect()) == accepted_ids(folder)


def test_stream_imports_each_file_once(spark, folder, paths, tmp_path):
    def run():
        import_landed(spark, folder, paths["emails"], str(tmp_path / "cp"), TODAY).awaitTermination()
        return sorted(r.id for r in tables.read_emails(spark, paths["emails"]).collect())

    ids = accepted_ids(folder)
    assert run() == ids
    with open(os.path.join(folder, "h.json"), "w") as out:
        out.write(message("9", "late"))
    assert run() == [*ids, "9"]


def emails_frame(spark):
    rows = [
        ("1", "2024-01-01", "a", "Receipt", "x" * 60, "p1", "h1"),
        ("2", None, "a", "Invoice", "short", "p2", "h2"),
        ("3", None, "a", "Notes", "y" * 60, "p3", "h3"),
        ("4", None, "a", "Order", "z" * 60, "p4", "h4"),
    ]
    return spark.createDataFrame(rows, schemas.EMAILS)


def test_embed_twice(spark, paths):
    emails = emails_frame(spark)

    def fussy(texts):
        if any("Notes" in t for t in texts):
            raise ValueError
        return [[1.0, 2.0] for _ in texts]

    for hook, ids in [(fussy, ["1", "2", "4"]), (fussy, []), (None, ["3"])]:
        stored = tables.read_embeddings(spark, paths["embeddings"])
        new = staging.staged(embed_pending(emails, stored, hook), "vectors")
        assert sorted(r.email_id for r in new.collect()) == ids
        tables.append_embeddings(new, paths["embeddings"])


def test_ledger_twice(spark, paths):
    emails = emails_frame(spark)

    def model(texts):
        return ['{"amount":"5","merchant":"M"}' if "Receipt" in t else "{}" for t in texts]

    for expected in [(4, 3, 2, 1), (4, 2, 1, 0)]:
        new, summary = build_ledger(emails, tables.read_tx(spark, paths["tx"]), hook=model)
        assert tuple(summary.first()) == expected
        tables.append_tx(staging.staged(new, "tx"), paths["tx"])
    assert [r.amount_cents for r in tables.read_tx(spark, paths["tx"]).collect()] == [500]


def test_ledger_scope_both(spark, paths):
    rows = [("1", None, "a", "Hello", "receipt " * 10, "p", "h")]
    emails = spark.createDataFrame(rows, schemas.EMAILS)
    tx = tables.read_tx(spark, paths["tx"])
    replies = spark.createDataFrame([("1", '{"amount":1}')], "email_id string, reply string")
    assert build_ledger(emails, tx, replies)[0].count() == 0
    assert build_ledger(emails, tx, replies, scope="both")[0].count() == 1


def test_default_rule_replies(spark, paths):
    rows = [("1", "2024-01-01", "a", "Your order", "You paid EUR 12.50 to us. " * 3, "p", "h")]
    emails = spark.createDataFrame(rows, schemas.EMAILS)
    new, _ = build_ledger(emails, tables.read_tx(spark, paths["tx"]))
    row = new.first()
    assert (row.merchant, row.amount_cents, row.currency, row.tx_date) == (
        "Your order", 1250, "EUR", "2024-01-01"
    )


TX = [
    ("t1", "m1", "Uber", 1234, None, "2024-03-01", "c", 1.0),
    ("t2", "m2", "Uber", 50, "USD", "2024-03-02", "c", 1.0),
    ("t3", "m3", None, 5, "EUR", None, "c", 1.0),
    ("t4", "m4", "Cafe", None, "CHF", "2024-03-03", "c", 1.0),
]
REPLIES = {
    '{"merchant":"UBER","metric":"sum"}': ["Total spent: 0.50 USD", "Total spent: 12.34 USD"],
    '{"merchant":"cafe","metric":"sum"}': ["Total spent: 0.00 CHF"],
    '{"merchant":"nobody"}': ["No transactions found matching your criteria."],
    '{"merchant":"nobody","metric":"sum"}': ["No transactions found matching your criteria."],
    "who knows": ["Could not understand the query."],
    '{"merchant":"Uber","metric":"list"}': [
        "Found 2 transactions:",
        "- 2024-03-02: Uber (0.50 USD)",
        "- 2024-03-01: Uber (12.34 None)",
    ],
    '{"end_date":"2024-03-01","metric":"list"}': [
        "Found 1 transactions:",
        "- 2024-03-01: Uber (12.34 None)",
    ],
}


def test_ask_one_and_many_give_the_same_lines(spark):
    tx = spark.createDataFrame(TX, schemas.TX)
    questions = spark.createDataFrame(list(enumerate(REPLIES)), "qid long, reply string")
    lines = ask.ask_many(questions, tx).orderBy(
        "qid", "part", F.desc_nulls_last("tx_date"), "line"
    )
    many = {}
    for row in lines.collect():
        many.setdefault(row.qid, []).append(row.line)
    assert many == dict(enumerate(REPLIES.values()))
    for reply, expected in REPLIES.items():
        assert [r.line for r in ask.ask(tx, reply).collect()] == expected


def test_ask_by_hook(spark):
    questions = spark.createDataFrame([(1, "How much?")], "qid long, question string")
    answered = ask.asked(questions, lambda texts: ['{"metric":"sum"}' for _ in texts])
    assert [tuple(r) for r in answered.collect()] == [(1, '{"metric":"sum"}')]


class Session:
    """A session without the setting."""

    def __init__(self, master):
        self.conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})
        self.sparkContext = type("Context", (), {"master": master})


def test_shared_folder(spark):
    assert staging.stage_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    local = staging.shared_folder(Session("local[4]"))
    assert os.path.isdir(local) and staging.shared_folder(Session("local[2]")) == local
    with pytest.raises(ValueError):
        staging.shared_folder(Session("yarn"))


def test_landed_files_are_written_where_they_stay(spark, tmp_path):
    rows = [("b/1", "{1}"), ("b/1", "{2}"), ("_c", "é"), (None, "x"), (None, "x")] + [(f"m{i}", str(i)) for i in range(50)]
    folder = f"{tmp_path}/landed"
    landing.land_messages(spark.createDataFrame(rows, "file string, text string"), folder)
    names = [name for _, _, found in os.walk(folder) for name in found]
    assert len(names) == 53 and all(name.endswith(".json") for name in names)  # no marks, no check sums
    texts = [r.text for r in landing.scan_messages(spark, folder, nested=True).collect()]
    assert sorted(sorted(text.split("\n")) for text in texts) == sorted(
        [["", "{1}", "{2}"], ["", "é"], ["", "x", "x"]] + [["", str(i)] for i in range(50)]
    )
    landing.land_messages(spark.createDataFrame([], "file string, text string"), f"{tmp_path}/none")
    assert landing.scan_messages(spark, f"{tmp_path}/none", nested=True).count() == 0


def spark_scan(spark, folder):
    """What Spark's reader, which lists the files on the driver, finds."""
    files = spark.read.option("pathGlobFilter", "*.json").option("recursiveFileLookup", True)
    return sorted(map(tuple, landing.as_messages(files.text(folder, wholetext=True)).collect()))


def test_a_nested_scan_leaves_no_files_to_the_driver(spark, tmp_path):
    folder = tmp_path / "a b%20é"
    names = (
        "a.json b.txt c.JSON .h.json _u.json _u=1.json _metadata.json s/a.json s/t/u.json .hid/a.json _hid/a.json "
        "_p=1/a.json p=1/a.json _metadata/a.json _common_metadata/_x/a.json q._COPYING_/a.json f.json/a.json "
        "%41.json \u3000\u2003中😀.json #?&=+,;@$!*'()~^|<>[]{}\\.json \x7f\x85.json .json s/.json"
    ).split(" ")
    found = {name: name.encode() for name in [*names, "s p.json"]}
    found |= {"empty.json": b"", "s/empty.json": b"", "bom.json": b"\xef\xbb\xbfx\r\n", "nul.json": b"a\x00b"}
    found |= {f"long{i}.json": b"x" * (3 << 20) for i in range(3)}
    for name, data in found.items():
        (folder / name).parent.mkdir(parents=True, exist_ok=True)
        (folder / name).write_bytes(data)
    (folder / "none").mkdir()
    for path in (f"{folder}", f"file://{folder}/", f"{folder}/s", f"{folder}/none"):
        scan = landing.scan_messages(spark, path, nested=True)
        assert scan.inputFiles() == []
        assert sorted(map(tuple, scan.collect())) == spark_scan(spark, path)
    assert len(spark_scan(spark, str(folder))) == 18
    (folder / "bad.json").write_bytes(b"\xff")
    assert landing.scan_messages(spark, str(folder), nested=True).filter("text IS NULL").count() == 1


def test_spark_reads_nested_folders_that_tasks_do_not_know(spark, tmp_path):
    (tmp_path / "x" / "y").mkdir(parents=True)
    (tmp_path / "x" / "y" / "a.json").write_text("{}")
    spark._jsc.hadoopConfiguration().set("fs.viewfs.mounttable.landed.link./in", f"file://{tmp_path}")
    for path in ("viewfs://landed/in", f"{tmp_path}/*"):
        scan = landing.scan_messages(spark, path, nested=True)
        assert [r.text for r in scan.collect()] == ["{}"] and len(scan.inputFiles()) == 1
    with pytest.raises(AnalysisException):
        landing.scan_messages(spark, f"{tmp_path}/none", nested=True)
