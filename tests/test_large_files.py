import random

import pytest

from inkveil import Config, find
from inkveil.sources.large_files import find_in_files, lines_of


def planted(seed, n=400):
    """Lines of all lengths, empty ones, values that go on over line feeds, and characters outside the BMP."""
    r = random.Random(seed)
    made = []
    for i in range(n):
        kind = r.randrange(9)
        made.append(
            [
                f"u{i}@mail{i % 7}.example.com from 10.0.{i % 256}.7",
                "",
                "-----BEGIN RSA PRIVATE KEY-----\n" + "\n".join("q" * r.randint(1, 64) for _ in range(r.randint(1, 6))) + "\n-----END RSA PRIVATE KEY-----",
                "login:\nalice_" + str(i),
                "é😀" * r.randint(0, 90) + f" https://h{i}.example.com/p",
                "SRV-DB-1 : ok=0",
                "x" * r.randint(0, 300),
                "GB29 NWBK 6016 1331 9268\r",
                f"open /var/log/app{i}/x.log now",
            ][kind]
        )
    return "\n".join(made)


@pytest.mark.parametrize(("piece", "margin"), [(1000, 700), (4096, 1024), (1 << 20, 1 << 16)])
def test_as_the_whole_file(spark, tmp_path, piece, margin):
    texts = {f"f{k}.log": planted(k) for k in range(3)} | {"empty.log": "", "open.log": "10.0.0.1", "one.log": "10.0.0.1\n"}
    (tmp_path / "in").mkdir()
    for name, text in texts.items():
        (tmp_path / "in" / name).write_bytes(text.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = sorted((r.file.rsplit("/", 1)[1], *r[1:]) for r in find_in_files(spark, str(tmp_path / "in"), Config(), piece, margin).collect())
        assert lines_of(spark, str(tmp_path / "in")).select("file", "block").distinct().count() > 9
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    whole = spark.createDataFrame(list(texts.items()), "file string, text string")
    want = sorted(tuple(r) for r in find(whole, Config(), ["file"]).select("file", "type", "value", "start", "end").collect())
    assert got == want and len(want) > 600
