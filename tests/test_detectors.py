import random
import re
import time

import pytest

from checks import duck
from inkveil import Config, catalog, find
from inkveil.functions import matching, pyengine
from inkveil.operators.candidates import with_candidates
from inkveil.plans.pipelines import spanned

DEMO = (
    "10:00:01 ERROR link from 10.1.2.3 dropped\n"
    "10:00:02 WARN  no answer of cache-07.lan.internal so far\n"
    "10:00:03 INFO  next try with user=mlee@north-hill.org\n"
    "10:00:04 ERROR token sk-live-4bQz8RstUvW9876543210 refused\n"
)

GOLDENS = [
    (
        DEMO,
        [
            ("ipv4", "10.1.2.3"),
            ("hostname", "cache-07.lan.internal"),
            ("email", "mlee@north-hill.org"),
            ("api_key", "sk-live-4bQz8RstUvW9876543210"),
        ],
    ),
    ("user=a.example.com", [("username", "a.example.com")]),
    ("4111111111111112", []),
    ("4111 1111 1111 1111", [("credit_card", "4111 1111 1111 1111")]),
    ("+1 23 45 67", []),
    ("api_key=Zqxw0123456789abcdef", [("api_key", "Zqxw0123456789abcdef")]),
    ("api_key=Zq0123456789abcdef", [("iban", "Zq0123456789abcdef")]),
    ("password: 'abcdefghijklmnop'", [("api_key", "abcdefghijklmnop")]),
    ("ok: [SRV-1]", [("server_name", "SRV-1")]),
    ("[DB-1-x] up", [("server_name", "DB-1-x")]),
    ("std::x", [("ipv6", "d::")]),
    ("BE68539007547034 ok", [("iban", "BE68539007547034 ok")]),
    ("x\nSRV-A : ok=0", []),
    ("SRV-A : ok=0", [("server_name", "SRV-A")]),
    ("| SRV-A   ok=0", [("server_name", "SRV-A")]),
    ("u=bob, u=a", [("username", "bob")]),
    ("u=bob u=alice", [("username", "bob"), ("username", "alice")]),
    (" root@10.0.0.1", [("username", "root"), ("ipv4", "10.0.0.1")]),
    ("x\\r\\nroot@10.0.0.1", [("username", "root"), ("ipv4", "10.0.0.1")]),
    ("C:\\a\\b\\", [("path_windows", "C:\\a\\b")]),
    ("x/var/log/a /var/log/b", [("path_unix", "/var/log/b")]),
    ("-----BEGIN EC PRIVATE KEY-----\nab\n-----END RSA PRIVATE KEY-----", [("private_key", "-----BEGIN EC PRIVATE KEY-----\nab\n-----END RSA PRIVATE KEY-----")]),
    ("Server=a;Pwd=b;x=1;Password=c;y=2", [("connection_string", "Server=a;Pwd=b;x=1;Password=c")]),
    ("see https://h.example.com/a(b).", [("url", "https://h.example.com/a(b).")]),
    ("a@b.com.1x", [("email", "a@b.com")]),
    ("10.0.0.256 10.0.0.1/24", [("ipv4", "10.0.0.1/24")]),
    ("1/2/24 and 2024-13-01", [("date", "1/2/24")]),
    ("ſerver ſ=1 uſer=bob1", [("username", "bob1")]),
    ("٣/٣/٢٤ 1/1/٢٤", [("date", "1/1/٢٤")]),
    ("", []),
    (None, []),
]


def test_goldens(spark, docs):
    rows = find(docs(*[text for text, _ in GOLDENS]), Config(), ["doc_id"]).collect()
    for i, (text, expected) in enumerate(GOLDENS):
        got = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start)
        assert [(r.type, r.value) for r in got] == expected, text
        assert all(text[r.start : r.end] == r.value for r in got)


def test_offsets_count_code_points(docs):
    row = find(docs("😀 é 10.0.0.1"), Config(), ["doc_id"]).first()
    assert (row.start, row.end) == (4, 12)


def test_text_with_the_separator_character(docs):
    rows = find(docs("a\x00b a@x.com \x00 10.0.0.1\x00"), Config(), ["doc_id"]).collect()
    assert sorted((r.type, r.start) for r in rows) == [("email", 4), ("ipv4", 14)]


def random_texts(seed, n):
    """Strings of pattern-like scraps, so that most types nearly match somewhere."""
    rng = random.Random(seed)
    scraps = (
        "a b1 Z9 - : :: . / \\ @ [ ] | ; = \n \t \x1c é ſ ² 10.0.0.1 255. 2001:db8: fe80:: aa:bb:cc:dd:ee:ff x.com ab.co.uk "
        "user= login: u=bob pwd= Server=a ;Password=x ;k=v https:// eyJabcdefghij .eyJabcdefghij 4111111111111111 411111111111111 "
        "FR76 3000 6000 0112 3456 +33 06 12 34 212- 555-0100 /var/log/ C:\\ ok: [SRV-1] DB-2 ok=1 sk- ghp_ 2024-01-02 1/2/24 "
        "123-45-6789 185057800608448 550e8400-e29b-41d4-a716-446655440000 -----BEGIN PRIVATE KEY----- -----END PRIVATE KEY----- "
        "abcdefghijklmnop 0123456789abcdef api_key= AIza"
    ).split(" ")
    return ["".join(rng.choice(scraps) + rng.choice(["", "", " "]) for _ in range(rng.randint(1, 14))) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_jvm_and_python_engines_agree(docs, seed):
    df = docs(*random_texts(seed, 1500))
    jvm = {r.doc_id: (r.text, r.spans) for r in spanned(df, Config()).collect()}
    python = {r.doc_id: (r.text, r.spans) for r in spanned(df, Config(), engine="python").collect()}
    assert sum(len(spans) for _, spans in jvm.values()) > 1000
    # Word characters differ in one known way: the JVM does not count ² as one.
    wrong = [(jvm[i], python[i][1]) for i in jvm if jvm[i] != python[i] and "²" not in jvm[i][0]]
    assert wrong == []


def test_possessive_forms_match_the_plain_ones():
    for kind in ("email", "hostname", "connection_string", "path_windows"):
        ours = re.compile(catalog.TYPE_BY_NAME[kind].pattern, re.I)
        plain = re.compile(duck.PLAIN[kind], re.I)
        for text in random_texts(3, 4000):
            assert pyengine.spans(ours, text) == [m.span() for m in plain.finditer(text)], (kind, text)


STRESS = {
    "private_key": "-----BEGIN PRIVATE KEY-----" + "x\n" * 500_000,
    "jwt": "eyJ" + "a" * 1_000_000,
    "connection_string": "Server=a" + ";k=v" * 250_000,
    "url": "https://" + "a" * 1_000_000,
    "email": "a@" + "b.c-d." * 20_000 + "1",
    "hostname": "a-b." * 5_000 + "com",
    "ipv6": "a:" * 500_000,
    "phone": "+1 " + "22 " * 300_000,
    "api_key": "password=" + "a" * 1_000_000,
    "path_windows": "C:\\" + "ab\\" * 300_000 + "c",
    "path_unix": "/var/" + "a/" * 500_000,
    "iban": "FR76 " + "ABCD " * 200_000,
    "username": "user=" + "a" * 1_000_000,
    "server_name": "[A" + "-B" * 300_000 + "|A" + "-B" * 300_000,
}


@pytest.mark.parametrize("kind", STRESS)
def test_long_runs_neither_overflow_nor_change(docs, kind):
    text = STRESS[kind]
    rows = find(docs(text), Config.of([kind]), ["doc_id"]).collect()
    regex = re.compile(catalog.TYPE_BY_NAME[kind].pattern, re.I)
    expected = pyengine.spans(regex, text)
    assert sorted((r.start, r.end) for r in rows) == expected


RUNS = ("a.", "a-", "a-b.", "a" * 70 + ".", "-a.", "a..", "ab" * 40)


@pytest.mark.parametrize("kind", ["hostname", "email"])
@pytest.mark.parametrize("run", RUNS)
def test_runs_without_a_name_take_linear_time(docs, kind, run):
    small = run * (3_000 // len(run)) + " x.com b@x.com " + run * 20 + "y.org c@" + run * 3 + "z.net"
    regex = re.compile(catalog.TYPE_BY_NAME[kind].pattern, re.I)
    rows = find(docs(small), Config.of([kind]), ["doc_id"]).collect()
    assert sorted((r.start, r.end) for r in rows) == pyengine.spans(regex, small)
    began = time.time()
    large = run * (1_000_000 // len(run)) + " x.com b@x.com"
    assert find(docs(large), Config.of([kind]), ["doc_id"]).count() >= 1
    assert time.time() - began < 20


def test_many_findings_in_one_text(docs):
    n = 30_000
    text = "".join(f"10.{i // 65536}.{i // 256 % 256}.{i % 256} " for i in range(n))
    rows = find(docs(text), Config(), ["doc_id"]).collect()
    assert len(rows) == n
    assert all(text[r.start : r.end] == r.value for r in rows)


def test_ascii_forms_find_the_same(spark):
    """Texts with and without a letter beyond ASCII take different forms of a pattern."""
    assert matching.ascii_regex(r"\[([A-C_-]+)[^\s\]][\s\S]\d") == (
        r"(?id)\[([\x2d\x5f\x61\x62\x63]+)[^\x09\x0a\x0b\x0c\x0d\x1c\x1d\x1e\x1f\x20\x5d][\s\S]\d"
    )
    r = random.Random(5)
    parts = [t for t, _ in GOLDENS if t and t.isascii()] + [chr(c) for c in range(128)] + ["\x1c\x1f", "\\", "[", "]", "K", "k=", "S"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(1, 12))) for _ in range(400)]
    plain = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    wide = spark.createDataFrame([(i, t + " \u4e2d") for i, t in enumerate(texts)], "doc_id int, text string")
    for config in (Config(), *(Config.of([name]) for name in ("username", "server_name", "iban", "api_key", "hostname"))):
        one, two = ({tuple(x) for x in find(df, config, ["doc_id"]).collect()} for df in (plain, wide))
        assert one == two and len(one) > 20
    got = {tuple(x) for x in find(plain, Config(), ["doc_id"]).collect()}
    assert got == {tuple(x) for x in find(plain, Config(), ["doc_id"], engine="python").collect()}


FRAGMENTS = (
    "u=|U=|user|User=|username:|usr |login = |bob|Al_ice-9|.|@|@10.0.0.1|1.2.3.4/24|256.1.1.1|a.b.com|x-y.CO|-|_|example.com|A.B+c%d@Foo-bar.example.com.|..|/|"
    "/VAR/log|/home/a.b@c%d-e|//etc/x|C:\\|c:\\\\data\\f.txt|Z:\\a b\\c|:|::|\\n|\\r\\n|fe80::1|aa:bb:cc:dd:ee:ff|AABB.CCDD.EEFF|(212) 555-0123|+33 6 12 34 56 78|"
    "0612345678|212-555-0123| |\t|\n|\x1c|\x0b|,|;|\"|'|[|]|[SRV-DB-1]|ok: [host1]|FR76 3000 6000 0112 3456 7890 189|DE89 ABCD EFGH 1|4111 1111 1111 1111|378282246310005|"
    "123-45-6789|185057800604836|185052A00604836|2024-01-31|31/12/1999|https://h.x/p?q=1|eyJhbGciOiJIUzI1.eyJzdWIiOiIxMjM0.c2lnbmF0dXJl|api_key=|password: |"
    "Zqxw0123456789abcdef|sk-abcdEFGH0123456789|xoxb-1234567890ab|Server=db1;Database=x;Pwd=s3c|550e8400-e29b-41d4-a716-446655440000|0|12|1234|b|Z|com|web3"
).split("|") + ["|", "|SRV-A-1 |", "-----BEGIN RSA PRIVATE KEY-----\nabc\n-----END RSA PRIVATE KEY-----"]


def test_short_texts_are_searched_in_batches(docs):
    """Short ASCII texts meet Arrow's regexes and not the JVM's, with the findings of Python's; others pass by, with theirs."""
    pick = random.Random(5)
    texts = ["".join(pick.choices(FRAGMENTS, k=pick.randint(0, 12))) for _ in range(4000)]
    odd = [None, "", "mail a@b.com \x00 u=bob ", "mél a@b.com u=bob ", "mail a@b.com " + "x " * 600 + "u=bob "]
    table = docs(*texts, *odd)
    assert "ArrowEvalPython" in with_candidates(table, Config())._jdf.queryExecution().executedPlan().toString()
    rows = {e: sorted(map(tuple, find(table, Config(), ["doc_id"], engine=e).collect())) for e in ("jvm", "python")}
    assert rows["jvm"] == rows["python"]
    assert len({r[0] for r in rows["jvm"]}) > 2000 and {r[0] for r in rows["jvm"]} >= {4002, 4003, 4004}


def test_files_of_lines_are_searched_in_batches(docs):
    """ASCII texts of many lines count as short too, and have the findings of Python's patterns."""
    pick = random.Random(6)
    texts = ["\n".join("".join(pick.choices(FRAGMENTS, k=6)) for _ in range(pick.choice((40, 150)))) for _ in range(60)]
    assert sum(map(pyengine_takes, texts)) == 60 and max(map(len, texts)) > 4096
    table = docs(*texts)
    rows = {e: sorted(map(tuple, find(table, Config(), ["doc_id"], engine=e).collect())) for e in ("jvm", "python")}
    assert rows["jvm"] == rows["python"] and len(rows["jvm"]) > 3000


def pyengine_takes(text: str) -> bool:
    return text.isascii() and "\x00" not in text and 1024 < len(text) <= pyengine.SHORT_BYTES
