import pytest

from inkveil import Config
from inkveil.operators import mapping as maps
from inkveil.plans.pipelines import redact_into
from inkveil.sources import session
from inkveil.sources.versions import VersionedStore


def entries(spark, rows):
    """``(scope, value, n)``"""
    full = [(s, v, f"[IP_{n:03d}]", "IP", n, n, 0) for s, v, n in rows]
    return spark.createDataFrame(full, maps.empty_mapping(spark).schema)


def scopes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "scope string")


def kept(df):
    return sorted((r.scope, r.value, r.n) for r in df.collect())


def texts(spark, team, *lines):
    return spark.createDataFrame([(i, team, t) for i, t in enumerate(lines)], "doc_id bigint, team string, text string")


def add(store, spark, *rows):
    return store.add(lambda known, tops: entries(spark, rows), scopes(spark, *{r[0] for r in rows}))


def test_versions_add_up(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    assert store.latest() == 0 and store.load().count() == 0 and store.counters().count() == 0
    add(store, spark, ("a", "v", 1), ("b", "v", 1))
    add(store, spark, ("a", "w", 2))
    assert store.latest() == 2 and kept(store.load()) == [("a", "v", 1), ("a", "w", 2), ("b", "v", 1)]
    assert kept(store.load(upto=1)) == [("a", "v", 1), ("b", "v", 1)]
    assert sorted(map(tuple, store.counters().collect())) == [("a", "IP", 2), ("b", "IP", 1)]
    assert ("a", "w", 2) in kept(store.load(scopes=scopes(spark, "a")))


def test_forget_and_compact(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    add(store, spark, ("a", "v", 1), ("b", "v", 1))
    store.forget(["a"])
    assert kept(store.load()) == [("b", "v", 1)]
    add(store, spark, ("a", "x", 1))
    store.forget(["b", "nobody"])
    store.compact()
    assert kept(store.load()) == [("a", "x", 1)] and len(store.versions()) == 1
    assert sorted(map(tuple, store.counters().collect())) == [("a", "IP", 1)]
    with pytest.raises(ValueError):
        store.load(upto=1)


def test_sessions_replace_each_other(spark, tmp_path):
    for rows in ([("s", "old", 1), ("t", "old", 1)], [("s", "new", 1)]):
        session.save_session(spark, Config(), entries(spark, rows), str(tmp_path))
        VersionedStore(spark, f"{tmp_path}/mapping").forget(["t"])
    assert kept(session.load_session(spark, str(tmp_path))[1]) == [("s", "new", 1)]
    session.save_session(spark, Config(), entries(spark, [("t", "again", 1)]), str(tmp_path))
    assert kept(session.load_session(spark, str(tmp_path))[1]) == [("t", "again", 1)]


@pytest.mark.parametrize("same", [True, False])
def test_two_writers_lose_nothing(spark, tmp_path, same):
    """The second writer commits while the first one is between reading and committing."""
    one, two = (VersionedStore(spark, str(tmp_path), buckets=1 << 20) for _ in range(2))
    made = []

    def make(known, tops):
        made.append(1)
        if len(made) == 1:
            redact_into(texts(spark, "x" if same else "y", "10.0.0.1", "10.0.0.2"), Config(), two, doc="doc_id", scope="team")
        return entries(spark, [("x", "10.0.0.9", 1 + sum(r.top for r in tops.where("scope = 'x'").collect()))])

    one.add(make, scopes(spark, "x"))
    # Only a writer that met the same scope makes its entries again.
    assert len(made) == (2 if same else 1) and one.latest() == 2
    other = "x" if same else "y"
    assert kept(one.load()) == sorted([(other, "10.0.0.1", 1), (other, "10.0.0.2", 2), ("x", "10.0.0.9", 3 if same else 1)])


def test_a_taken_number_is_refused(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    add(store, spark, ("a", "v", 1))
    taken = store.versions()[0]
    assert not store._commit(taken) and store.latest() == 1
    assert not [p for p in (tmp_path / "log").iterdir() if p.name.startswith("_")]


def test_a_replayed_batch_gives_the_same(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path))
    for _ in range(2):
        done = redact_into(texts(spark, "t", "10.0.0.1 a@x.com"), Config(), store, doc="doc_id", scope="team", writer="w", batch=3)
        assert [r.redacted for r in done.redacted.collect()] == ["[IP_001] [EMAIL_001]"] and done.added.count() == 2
    assert store.latest() == 1
    store.compact()
    done = redact_into(texts(spark, "t", "10.0.0.1 a@x.com"), Config(), store, doc="doc_id", scope="team", writer="w", batch=3)
    assert [r.redacted for r in done.redacted.collect()] == ["[IP_001] [EMAIL_001]"] and done.added.count() == 0


def test_only_buckets_of_the_scopes_are_read(spark, tmp_path):
    store = VersionedStore(spark, str(tmp_path), buckets=1 << 20)
    add(store, spark, *((f"s{i}", "v", 1) for i in range(20)))
    some = store.load(scopes=scopes(spark, "s3", "s7", "none"))
    assert kept(some) == [("s3", "v", 1), ("s7", "v", 1)] and len(some.inputFiles()) == 2
