"""Decoders against public vectors, sources, archives and streams."""

import struct
from datetime import datetime

import pyarrow.fs  # noqa: F401
import pytest
from pyspark.sql import functions as F

from coinstrata import schemas
from coinstrata.functions import chain
from coinstrata.functions import columns as C
from coinstrata.plans import base, explorer
from coinstrata.sources import blocks as B
from coinstrata.streaming import replay
from coinstrata.streaming.sync import LedgerStore, follow_blocks, follow_mempool, load_blocks

#: The first block of the oldest chain.
GENESIS = (
    "0100000000000000000000000000000000000000000000000000000000000000000000003ba3edfd7a7b12b27ac72c3e67768f617fc81bc3888a51323a9fb8aa4b1e5e4a"
    "29ab5f49ffff001d1dac2b7c0101000000010000000000000000000000000000000000000000000000000000000000000000ffffffff4d04ffff001d0104455468652054"
    "696d65732030332f4a616e2f32303039204368616e63656c6c6f72206f6e206272696e6b206f66207365636f6e64206261696c6f757420666f722062616e6b73ffffffff"
    "0100f2052a01000000434104678afdb0fe5548271967f1a67130b7105cd6a828e03909a67962e0ea1f61deb649f6bc3f4cef38c4f35504e51ec112de5c384df7ba0b8d57"
    "8a4c702b6bf11d5fac00000000"
)
TXID = "4a5e1e4baab89f3a32518a88c31bc87f618f76673e2cc77ab2127b7afdeda33b"


def test_first_block():
    b = chain.read_block(bytes.fromhex(GENESIS))
    assert b["block_hash"] == "000000000019d6689c085ae165831e934ff763ae46a2a6c172b3f1b60a8ce26f" and b["bits"] == "1d00ffff"
    (tx,) = b["transactions"]
    assert tx["tx_id"] == TXID and tx["inputs"] == [{"prev_tx_id": "0" * 64, "prev_vout": -1}]
    assert tx["outputs"] == [{"address": "1A1zP1eP5QGefi2DMPTfTL5SLmv7DivfNa", "amount_sat": 5_000_000_000}]


@pytest.mark.parametrize(
    "script,name,address",
    [
        ("0014751e76e8199196d454941c45d1b3a323f1433bd6", "btc", "bc1qw508d6qejxtdg4y5r3zarvary0c5xw7kv8f3t4"),
        ("512079be667ef9dcbbac55a06295ce870b07029bfcdb2dce28d959f2815b16f81798", "btc", "bc1p0xlxvlhemja6c4dqv22uapctqupfhlxm9h8z3k2e72q4k9hcz7vqzk5jj0"),
        ("76a914" + "00" * 20 + "88ac", "mvc", schemas.BURN_ADDRESS),
        ("a914" + "00" * 20 + "87", "btc", "31h1vYVSYuKP6AhS86fbRdMw9XHieotbST"),
        ("6a04deadbeef", "btc", schemas.ERR_ADDRESS),
        ("0014751e76e8199196d454941c45d1b3a323f1433bd6", "doge", schemas.ERR_ADDRESS),
        ("", "btc", schemas.ERR_ADDRESS),
    ],
)
def test_addresses(script, name, address):
    assert chain.script_address(bytes.fromhex(script), name) == address


def test_doge_addresses_start_with_d_and_nine_or_a():
    assert chain.script_address(bytes.fromhex("76a914" + "12" * 20 + "88ac"), "doge")[0] == "D"
    assert chain.script_address(bytes.fromhex("a914" + "12" * 20 + "87"), "doge")[0] in "9A"


def raw_tx(version=1, witness=False):
    body = b"\x01" + b"\x11" * 32 + struct.pack("<I", 3) + b"\x02ab" + b"\xff" * 4 + b"\x01" + struct.pack("<Q", 7) + b"\x01\x6a"
    marker, tail = (b"\x00\x01", b"\x01\x02hi") if witness else (b"", b"")
    return struct.pack("<I", version) + marker + body + tail + b"\0" * 4


def test_witness_does_not_change_the_id():
    ids = [chain.transaction_id(chain.read_transaction(chain.Bytes(raw_tx(witness=w)), True), False) for w in (False, True)]
    assert ids[0] == ids[1] and ids[0] == chain.sha256d(raw_tx())[::-1].hex()


def test_hashed_scripts_change_the_id_from_version_ten():
    ids = {v: [chain.transaction_id(chain.read_transaction(chain.Bytes(raw_tx(v)), False), h) for h in (False, True)] for v in (9, 10)}
    assert ids[9][0] == ids[9][1] and ids[10][0] != ids[10][1]


def test_merge_mined_block():
    header = bytes.fromhex(GENESIS)[:80]
    proof = raw_tx() + b"\0" * 32 + b"\x02" + b"\1" * 64 + b"\0" * 4 + b"\x00" + b"\0" * 4 + b"\2" * 80
    raw = struct.pack("<I", 0x620104) + header[4:] + proof + b"\x01" + raw_tx()
    assert [t["tx_id"] for t in chain.read_block(raw, "doge")["transactions"]] == [chain.sha256d(raw_tx())[::-1].hex()]


def test_truncated_data():
    with pytest.raises(ValueError):
        chain.read_block(bytes.fromhex(GENESIS)[:-9])


def test_sql_functions(spark):
    chain.register_functions(spark)
    sid = "".join(f"{i:02x}" for i in range(32)) + "02000000"
    r = spark.sql(
        f"select parse_sensible_id('{sid}') as p, parse_sensible_id('zz') as q, address_of_script(unhex('76a914{'00' * 20}88ac'), 'btc') as a,"
        f" address_of_hash(unhex('{'00' * 20}'), 'btc') as b, hex(hash160_of(unhex(''))) as h, tx_id_of(unhex('{raw_tx().hex()}'), 'btc') as t"
    ).first()
    assert (r.p.tx_id, r.p.vout, r.q) == ("".join(f"{i:02x}" for i in range(31, -1, -1)), 2, None)
    assert r.a == r.b == schemas.BURN_ADDRESS and r.h.lower() == "b472a266d0bd89c13706a4132ccfb16f7c3b9fcb" and r.t == chain.sha256d(raw_tx())[::-1].hex()


def test_column_functions(spark):
    c = F.col
    df = spark.createDataFrame([("/abc/longest-run.x/", "0011ff", "tx:a:7", "", " 12", 123456789, "1d00ffff", "a" * 40)], "s string, h string, o string, e string, n string, v long, b string, l string")
    r = df.select(
        C.miner_tag(c("s")), C.reversed_hex(c("h")), C.outpoint_parts(c("o")), C.address_or_error(c("e")), C.amount_or_zero(c("n")), C.coins(c("v")), C.bits_value(c("b")),
        C.shortened(c("l")), C.padded_index(c("v"), 12), C.padded_index(c("l"), 3), C.to_satoshi(F.lit(0.29)), C.is_block_hash(c("l")), C.miner_tag(c("e")),
        C.split_segments(F.lit(",a@b,c,d@e@f"), 2), F.hex(C.double_sha256(F.lit(b""))),
    ).first()
    assert tuple(r)[:13] == ("longest-run.x", "ff1100", ("tx:a", 7), "errAddress", 12, 1.23456789, 486604799, "aaaaaa...aaaaaa", "000123456789", "a" * 40, 29000000, False, "")
    assert r[13] == [["a", "b"], ["d", "e", "f"]] and r[14].lower() == chain.sha256d(b"").hex()


def staged(tmp_path):
    folder = tmp_path / "staged"
    folder.mkdir()
    for h in (1, 2, 5):
        (folder / f"{h}.blk").write_text(GENESIS + "\n")
    (folder / "note.txt").write_text("no block")
    return f"file://{folder}"


def test_staged_blocks_and_data_source(spark, tmp_path):
    path = staged(tmp_path)
    raw = B.read_chain(spark, path)
    assert sorted((r.height, r.transactions[0].tx_id) for r in raw.collect()) == [(h, TXID) for h in (1, 2, 5)]
    spark.dataSource.register(B.ChainSource)
    rows = spark.read.format("ledger_chain").options(path=path, chain="btc", first=1, last=9, parts=4).load()
    assert rows.rdd.getNumPartitions() >= 3
    assert sorted(tuple(r) for r in B.as_raw_blocks(rows).select("height", "block_hash").collect()) == sorted(tuple(r) for r in raw.select("height", "block_hash").collect())
    coin = explorer.coinbase_info(rows.filter("height = 1")).first()
    assert (coin.miner, coin.reward_sat) == ("Chancellor", 5_000_000_000)


T0 = datetime(2024, 1, 1)


def some_blocks(spark, n=30):
    rows = []
    for h in range(n):
        inputs = [(f"t{h - 1}", 0)] if h else []
        rows.append((h, f"h{h}", T0, [(f"t{h}", inputs, [(f"a{h % 3}", 100 + h), (f"a{h % 5}", 7)]), (f"u{h}", [(f"t{h}", 1), ("lost", 0)], [("a9", 6)])]))
    return spark.createDataFrame(rows, schemas.RAW_BLOCKS)


def test_archive_prunes_folders(spark, tmp_path):
    path = f"file://{tmp_path}/archive"
    B.write_archive(some_blocks(spark).withColumn("height", F.col("height") * 100), path)
    part = B.read_archive(spark, path, 1000, 1999)
    assert sorted(r.height for r in part.collect()) == list(range(1000, 2000, 100))
    assert "PartitionFilters: [isnotnull(" in part._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert B.read_archive(spark, path).count() == 30


def test_stream_equals_batch_with_restarts(spark, tmp_path):
    blocks, source, ledger = some_blocks(spark), f"file://{tmp_path}/in", LedgerStore(spark, f"file://{tmp_path}/ledger")
    for lo, hi in ((0, 9), (10, 19), (20, 29)):
        blocks.filter(F.col("height").between(lo, hi)).coalesce(1).write.mode("append").parquet(source)
        follow_blocks(B.stream_blocks(spark, source, 1), ledger, f"{tmp_path}/checkpoint").awaitTermination()
    outputs, spends = load_blocks(blocks)
    now = ledger.ledger()
    assert sorted(map(tuple, now.outputs.collect())) == sorted(map(tuple, outputs.collect()))
    assert sorted(map(tuple, now.spends.collect())) == sorted(map(tuple, spends.collect()))
    # a batch that runs again changes nothing
    ledger.apply_blocks(blocks.filter("height between 20 and 29"), 2)
    assert ledger.ledger().outputs.count() == outputs.count() and ledger.ledger().spends.count() == spends.count()
    back = LedgerStore(spark, f"file://{tmp_path}/back")
    ledger.roll_back(20, back)
    assert back.ledger().outputs.agg(F.max("height")).first()[0] == 19


def test_replay_stages_blocks_in_many_tasks_and_in_order(spark, tmp_path):
    """No task has a whole period of the chain, blocks are made once, and a period's files are one batch."""
    from types import SimpleNamespace

    made = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    blocks = some_blocks(spark, 40).repartition(4, "height").mapInArrow(count, schemas.RAW_BLOCKS)
    star = SimpleNamespace(spark=spark, raw_blocks=blocks, heights={"lo": 0, "hi": 39})
    path, ledger, files = f"file://{tmp_path}/in", LedgerStore(spark, f"file://{tmp_path}/ledger"), []
    for _ in replay.stage_blocks(star, path):
        files.append(spark.read.parquet(path).select(F.input_file_name()).distinct().count())
        follow_blocks(B.stream_blocks(spark, path, replay.ALL_FILES), ledger, f"{tmp_path}/checkpoint").awaitTermination()
    assert made.value == 40
    assert len(files) == replay.PERIODS and files[-1] > replay.PERIODS
    outputs, spends = load_blocks(some_blocks(spark, 40))
    assert sorted(map(tuple, ledger.ledger().outputs.collect())) == sorted(map(tuple, outputs.collect()))
    assert sorted(map(tuple, ledger.ledger().spends.collect())) == sorted(map(tuple, spends.collect()))


def test_mempool_stream_eviction_and_reset(spark, tmp_path):
    ledger = LedgerStore(spark, f"file://{tmp_path}/ledger")
    assert ledger.read("outputs").count() == 0
    ledger.apply_blocks(some_blocks(spark, 3), 0)
    pool = spark.createDataFrame([("n1", T0, [("t2", 0)], [("a1", 5)]), ("n2", T0, [("n1", 0)], [("a2", 4)])], schemas.MEMPOOL_TXS)
    pool.write.parquet(f"file://{tmp_path}/pool")
    follow_mempool(B.stream_mempool(spark, f"file://{tmp_path}/pool"), ledger, f"{tmp_path}/cp").awaitTermination()
    now = ledger.ledger()
    assert sorted((r.prev_tx_id, r.address) for r in now.mempool_spends.collect()) == [("n1", "a1"), ("t2", "a2")]
    assert base.balance(now, "a1").first().mempool_income_satoshi == 5
    confirmed = spark.createDataFrame([(3, "h3", T0, [("n1", [("t2", 0)], [("a1", 5)])])], schemas.RAW_BLOCKS)
    ledger.apply_blocks(confirmed, 1)
    assert [r.tx_id for r in ledger.ledger().mempool_outputs.collect()] == ["n2"]
    ledger.reset_mempool(pool.filter("tx_id = 'n1'"))
    assert ledger.read("mempool_outputs").count() == 1


def test_legacy_rows(spark, tmp_path):
    (tmp_path / "x.txt").write_text("addr\t,t1@0@5@9,bad,t2@1@6@9\n")
    got = B.read_legacy(spark, f"file://{tmp_path}/x.txt", ["tx_id", "vout", "amount", "time"]).collect()
    assert [(r.key, r.tx_id, r.amount) for r in got] == [("addr", "t1", "5"), ("addr", "t2", "6")]
