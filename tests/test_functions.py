import numpy as np
import pytest

from tidelog.functions import bloom, codec
from tidelog.sources.binary import build_run, parse_log, parse_run

PUT_A, DELETE_A, PUT_KEY = (b"a", b"1", 0), (b"a", None, 1), (b"key", b"value", 0)


@pytest.mark.parametrize(
    "row, logged, stored",
    [
        (PUT_A, "443f46210100000001000000006131", "0100000001000000006131"),
        (DELETE_A, "c763e62f01000000000000000161", "01000000000000000161"),
        (PUT_KEY, "a5352d240300000005000000006b657976616c7565", "0300000005000000006b657976616c7565"),
    ],
)
def test_records(row, logged, stored):
    assert codec.log_record(*row).hex() == logged
    assert codec.run_record(*row).hex() == stored
    back = codec.read_log_record(codec.log_record(*row))
    assert (back.key, back.value, back.op) == row


def test_any_other_op_deletes():
    import zlib

    body = b"\x01\0\0\0\x01\0\0\0\x07ab"
    assert codec.read_log_record(codec.u32(zlib.crc32(body)) + body).op == 1


def test_log_is_read_to_its_first_bad_record():
    rows = [PUT_KEY, DELETE_A, PUT_A]
    raw = b"".join(codec.log_record(*r) for r in rows)
    ends = np.cumsum([len(codec.log_record(*r)) for r in rows]).tolist()
    for cut in range(len(raw) + 1):
        records, at, reason = parse_log(raw[:cut])
        whole = sum(e <= cut for e in ends)
        assert len(records) == whole and at == ([0, *ends][whole])
        assert (reason is None) == (cut == at)
    for flip in range(ends[0], ends[1]):
        bad = bytearray(raw)
        bad[flip] ^= 1
        assert len(parse_log(bytes(bad))[0]) == 1


HASHES = [
    (b"", "4be4a3edb7ad0038", "02a91dde42738d85", [2866, 6333, 214, 3681, 7148, 1029, 4496]),
    (b"a", "9bfdb4ef5afb5306", "080afbf35c7a6719", [452, 6341, 2644, 8533, 4836, 1139, 7028]),
    (b"key_000001", "3ade2a6abf9bc664", "da03ca5c5ebb0c95", [3188, 6285, 4214, 7311, 822, 3919, 7016]),
    (b"inserted_0", "cd3855a7babbeb45", "81223b03313405e6", [7023, 4141, 5677, 2795, 4331, 1449, 2985]),
    (b"\xff" * 8, "cba972b07a69b132", "1430ff7e3beeab98", [9078, 4998, 918, 2006, 7512, 3432, 8938]),
]


def test_hashes():
    h1, h2 = bloom.hash_pairs([k for k, *_ in HASHES])
    for i, (_, a, b, _) in enumerate(HASHES):
        assert (f"{h1[i]:016x}", f"{h2[i]:016x}") == (a, b)
    places = bloom.BloomFilter(9586, 7).places([k for k, *_ in HASHES])
    for i in range(5):
        assert places[i].tolist() == HASHES[i][3]


@pytest.mark.parametrize(
    "keys, rate, most, bits, hashes",
    [(1000, 0.10, 0.004, 4793, 3), (1000, 0.05, 0.003, 6236, 4), (1000, 0.01, 0.002, 9586, 7), (5000, 0.01, 0.002, 47926, 7), (10000, 0.001, 0.001, 143776, 10)],
)
def test_false_positives_are_as_rare_as_asked(keys, rate, most, bits, hashes):
    inserted = [f"inserted_{i}".encode() for i in range(keys)]
    f = bloom.BloomFilter.of(inserted, rate)
    assert (f.bits, f.hashes) == (bits, hashes) == bloom.sizing(keys, rate)
    assert f.maybe(inserted).all()
    measured = f.maybe([f"absent_{i}".encode() for i in range(100_000)]).mean()
    assert measured < rate + most
    assert abs(bloom.expected_rate(bits, hashes, keys) - rate) < rate * 0.1
    again = bloom.BloomFilter.decode(f.encode())
    assert again.encode() == f.encode()


@pytest.mark.parametrize("keys, want", [(0, (64, 20)), (1, (64, 20)), (16, (154, 7)), (200, (1918, 7))])
def test_small_filters(keys, want):
    assert bloom.sizing(keys, 0.01) == want


def test_damaged_filters_are_refused():
    with pytest.raises(ValueError):
        bloom.BloomFilter.decode(bytes(9))
    with pytest.raises(ValueError):
        bloom.BloomFilter.decode(codec.u64(800) + b"\x03abc")


def test_run_files():
    rows = [(f"k{i:04}".encode(), None if i % 7 == 0 else b"v" * i, int(i % 7 == 0)) for i in range(100)]
    raw = build_run(rows)
    records, index, f = parse_run(raw)
    assert [r[1:] for r in records] == rows
    assert [k for k, _ in index] == [r[0] for r in rows[::16]]
    assert [p for _, p in index] == [r[0] for r in records[::16]]
    assert f.maybe([r[0] for r in rows]).all()
    assert parse_run(build_run([]))[0] == []
    for bad in (raw[:10], raw[:-16] + b"\xff" * 16):
        with pytest.raises(ValueError):
            parse_run(bad)
    with pytest.raises(ValueError):
        build_run([(b"b", b"", 0), (b"a", b"", 0)])


def test_filters_built_by_spark(spark):
    rows = spark.range(500).selectExpr("id % 3 as segment", "cast(concat('k', id) as binary) as key").repartition(5)
    for r in bloom.build_by_run(rows).collect():
        keys = [f"k{i}".encode() for i in range(500) if i % 3 == r.segment]
        assert bytes(r["filter"]) == bloom.BloomFilter.of(keys).encode()
