from __future__ import annotations

import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from fernwalk.llm import secret_scan as S
from tests.llm.conftest import clash, rows

HEX40 = "0123456789abcdef0123456789abcdef01234567"
KEY = "AKIA" + "ABCDEFGH12345678"


def plain_base(text):
    """The contract's patterns, written without any shortcut."""
    out = []
    either = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    name = "|".join([*(either(w) for w in ("password", "passwd", "secret", "token")), either("api") + "_?" + either("key")])
    for m in re.finditer(rf"({name})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["password", "PassWd", "ſecret", "toKen", "api_key", "ApiKey", '"', "'", " ", ":", "=", "abcdefgh", "a1b2", HEX40, KEY, "AKIA", "x", "\n", "é", "ff", "K"]), max_size=14))
def test_base_spans_are_the_contracts(parts):
    text = "".join(parts)
    assert [(s.kind, s.start, s.end) for s in S.scan_text(text)[0]] == plain_base(text)


def literals(text):
    return [text[s.start : s.end] for s in S.scan_text(text)[1] if s.kind == "literal"]


def test_names_make_literals_secret():
    assert literals('db_passphrase = "correct7horse9battery"') == ["correct7horse9battery"]
    assert literals('{"privateKey": "Zk3v9QpL0xY7wT2m"}') == ["Zk3v9QpL0xY7wT2m"]
    assert literals('colour = "Zk3v9QpL0xY7wT2m"') == []
    assert literals("auth_mode: enabled") == []
    assert literals('client_pwd = "changeme-example"') == []
    assert literals("nothing here at all") == []


def test_constants_are_propagated():
    text = 'BASE = "Zk3v9QpL0x"\nOTHER = BASE\nsigning_key = OTHER + "Y7wT2m"\n'
    assert sorted(literals(text)) == ["Y7wT2m", "Zk3v9QpL0x"]
    assert literals("a = b\nb = a\ncredential = a") == []


def test_what_a_base_span_holds_isnt_told_twice():
    base, spans = S.scan_text(f'token = "{HEX40}"')
    assert [s.kind for s in base] == ["assign", "hex"]
    assert spans == base


def test_redaction_takes_the_value_and_nothing_else():
    text = f'say token = "{HEX40}" and {KEY}.'
    assert S.redact(text) == 'say token = "[REDACTED]" and [REDACTED].'
    assert S.redact(S.redact(text)) == S.redact(text)
    assert S.redact(None) is None
    assert S.redact("clean text, really: yes") == "clean text, really: yes"


def test_odd_rows(spark, odd, none):
    got = rows(S.find_secrets(odd))
    assert got == rows(S.find_secrets(clash(odd)))
    assert len(got) == 9
    assert all(r[1:] == (0, 0, 0, "", "", 0) for r in got)
    assert S.find_secrets(none).collect() == []


def test_redacting_keeps_rows_and_columns(spark, odd, none):
    out = S.redact_secrets(clash(odd))
    assert out.columns == clash(odd).columns
    assert rows(out.drop("n_chars")) == rows(clash(odd).drop("n_chars"))
    assert S.redact_secrets(none).collect() == []
    df = spark.createDataFrame([(1, f"x token={HEX40} y", 99)], "doc_id long, text string, n_chars long")
    assert rows(S.redact_secrets(df)) == [(1, "x token=[REDACTED] y", 20)]


def reached(text):
    return sorted(text[s.start : s.end] for s in S.literal_spans(text))


def test_constants_go_through_names_concatenations_and_references():
    assert reached("a = 'AKx9vB2m'\nb = a + 'Q7rT5w'\npassword = b") == ["AKx9vB2m", "Q7rT5w"]
    assert reached("BASE=AKx9vB2mQ7rT5w\npassword=$BASE") == ["AKx9vB2mQ7rT5w"]
    assert reached("BASE=AKx9vB2mQ7rT5w\npassword=${BASE}") == ["AKx9vB2mQ7rT5w"]
    assert reached('BASE=AKx9vB2mQ7rT5w\nCOPY=$BASE\npassword="${COPY}"') == ["AKx9vB2mQ7rT5w"]
    assert reached("x = y\nx = 'AKx9vB2mQ7rT5w'\npassword = x") == ["AKx9vB2mQ7rT5w"]


def test_chains_of_any_length_and_circles():
    chain = "n0 = 'AKx9vB2mQ7rT5w'\n" + "".join(f"n{i + 1} = n{i}\n" for i in range(3000))
    assert reached(chain + "password = n3000") == ["AKx9vB2mQ7rT5w"]
    assert reached("a = b\nb = a\npassword = a") == []
    assert reached("a = a + b\npassword = a") == []
    doubled = "n0 = 'AKx9vB2mQ7rT5w'\n" + "".join(f"n{i + 1} = n{i} + n{i}\n" for i in range(60))
    assert reached(doubled + "password = n60") == ["AKx9vB2mQ7rT5w"]


def test_forms_of_assignments():
    one = ["AKx9vB2mQ7rT5w"]
    for text in (
        'os.environ["DB_PASSWORD"] = "{}"', "config['db_pwd']='{}'", 'pwd: str = "{}"', "let pwd: string = '{}';", "db_pwd := \"{}\"", "{{'pwd' => '{}'}}", "<pwd>{}</pwd>", '<pwd kind="x">\n  {}\n</pwd>',
        '<add key="db_pwd" value="{}"/>', 'pwd = """{}"""', "pwd = '''{}'''", "pwd: |\n  {}\nother: x", "- pwd: >-\n    {}", 'pwd = (\n  "{}"\n)', 'x = {{"base": 1}}\nbase["k"] = "{}"\npwd = base["k"]', "pwd = \\\n '{}'",
    ):
        assert reached(text.format(one[0])) == one, text
    for text in ('pwd = "AKx9vB2m" "Q7rT5w"', 'pwd = ("AKx9vB2m"\n       "Q7rT5w")', 'pwd = "AKx9vB2m" +\n "Q7rT5w"', 'pwd = "AKx9vB2m"\npwd += "Q7rT5w"', "a = 'AKx9vB2m'\na += 'Q7rT5w'\npwd = a"):
        assert reached(text) == ["AKx9vB2m", "Q7rT5w"], text
    assert reached("key:\n  pwd: |\n    AKx9vB2m\n\n    Q7rT5w\n  y: z") == ["AKx9vB2m\n\n    Q7rT5w"]
    assert reached('pwd = """never closed\nx = 1') == reached("pwd: |\nx: 1") == reached("<pwd></pwd>") == reached('x["pwd"]["y"') == []


SECRET = "Zk39xQp71LmW"
FORMS = (
    "dbpassword_value='{}'", "secretkey='{}'", "userpwd: '{}'", "export PGPASSWORD_PROD={}", "clientsecretvalue = '{}'", "authtoken2 = '{}'", "mysqlserverpassword='{}'", "APIKEYS = '{}'",
    'pw_secret = f"{}"', "db_pwd = b'{}'", "db_pwd = r'{}'", "db_pwd = u\"{}\"", "db_pwd = rb'{}'", 'wchar_t *db_pwd = L"{}";',
    'setPassword("{}")', "client.withToken('{}')", 'db_pwd = base64("{}")', 'x = os.getenv("DB_PWD", "{}")', 'db_pwd = os.getenv("NAME", "{}")', 'env.get("db_password") or setdefault("db_password", "{}")',
    'db_pwd = ["{}"]', 'API_KEY_LIST = {{"a": "{}"}}', "tokens = ['x', '{}']", "db_pwd = {{'prod': '{}', 'url': 'https://h/v1'}}",
    'db_pwd = x or "{}"', 'db_pwd = process.env.X || "{}"', 'db_pwd = a ?? "{}"', 'db_pwd ||= "{}"', "DB_PWD ?= '{}'", "db_pwd -> '{}'", "db_pwd <- '{}'", 'db_pwd = f(1) or "{}"',
    'const char *db_pwd = "{}";', 'char db_pwd[] = "{}";', 'char db_pwd[32] = "{}";', '#define DB_PWD "{}"', "#define DB_PWD {}", "setenv DB_PWD {}", 'user, db_pwd = "a", "{}"', 'db_pwd, n = "{}", 3', 'userpwd = "{}example"',
)


@pytest.mark.parametrize("form", FORMS)
def test_further_forms(form):
    found = reached("first line\n" + form.format(SECRET) + "\nlast = 'line'")
    assert [w.removesuffix("example") for w in found] == [SECRET]


def test_what_looks_like_a_secret_of_a_name_but_is_none():
    for text in (
        "passport = 'Zk39xQp71LmW'", "tokenizer: 'Zk39xQp71LmW'", "compass = 'Zk39xQp71LmW'", "secretary = 'Zk39xQp71LmW'", "author = 'Zk39xQp71LmW'", "monkey = 'Zk39xQp71LmW'",
        "password = os.getenv('PRODUCTION_DATABASE_PASSWORD')", "token_urls = ['https://host1.example/a']", "password = getpass('Password for user 1: ')", "db_pwd = 'your-Zk39xQp71'", "call('Zk39xQp71LmW')",
        "setPassword(value1)", "the password (see 'chapter 4a') is long: yes",
    ):
        assert reached(text) == [], text


def test_recall_and_precision_on_a_planted_table(spark):
    """Thousands of rows of code and prose; half of them hold a secret in some form."""
    r = random.Random(8)
    letters = "abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789"
    plain = ["for i in range(10):\n    total = total + 'step %d'", 'print("hello, world 2")', "Keys are kept in a safe place: see page 12.", 'colour = "#a1b2c3d4"', "url = 'https://host.example/v1/items'", "version: 1.2.3-rc4", "msg = f(\"item1\", 'b2c3d4e5f6')", "my_list = ['a1b2c3d4e5', 'x']"]
    rows, want = [], {}
    for i in range(4000):
        lines = r.choices(plain, k=r.randint(1, 6))
        if i % 2:
            value = "".join(r.choices(letters, k=r.randint(12, 30))) + "7q"
            lines.insert(r.randrange(len(lines) + 1), r.choice(FORMS[:-1]).format(value))
            want[i] = value
        rows.append((i, "\n".join(lines)))
    texts = dict(rows)
    found = {}
    for x in S.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        spans = [s.split(":") for s in x.spans.split(",") if s]
        found[x.doc_id] = {texts[x.doc_id][int(a) : int(b)] for _, a, b in spans}
        assert x.n_literal == sum(k == "literal" for k, _, _ in spans)
    hits = sum(any(v in f for f in found[i]) for i, v in want.items())
    false = sum(not (i in want and want[i] in f) for i, fs in found.items() for f in fs)
    assert hits / len(want) > 0.98 and false / max(1, sum(map(len, found.values()))) < 0.02, (hits, len(want), false)


def test_a_name_stands_for_what_was_last_assigned():
    assert reached("a = 'AKx9vB2mQ7rT5w'\na = 'Zk3v9QpL0xY7wT2m'\npwd = a") == ["Zk3v9QpL0xY7wT2m"]
    assert reached("a = 'AKx9vB2mQ7rT5w'\npwd = a\na = 'Zk3v9QpL0xY7wT2m'") == ["AKx9vB2mQ7rT5w"]
    assert reached("pwd = a\na = b\nb = 'Zk3v9QpL0xY7wT2m'") == ["Zk3v9QpL0xY7wT2m"]


def test_short_literals_on_demand():
    assert [S.as_text(S.scan_text("pwd = 'abc'", k)[1]) for k in (8, 0)] == ["", "literal:7:10"]
    assert S.as_text(S.scan_text("pwd = x\nx = 'a'", 0)[1]) == "literal:13:14"


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcd"), st.lists(st.one_of(st.sampled_from("abcd"), st.integers(0, 30)), min_size=1, max_size=3)), min_size=1, max_size=12))
def test_propagation_is_that_of_running_the_program(program):
    """Against an evaluation line by line, for programs in which names are set before they are used."""
    lines, env, at = [], {}, 0
    for name, terms in program:
        terms = [t for t in terms if isinstance(t, int) or t in env] or [0]
        parts, value = [], []
        for t in terms:
            if isinstance(t, int):
                literal = f"L{t}q{len(lines)}w{len(parts)}zX9"
                parts.append(f"'{literal}'")
                value.append(literal)
            else:
                parts.append(t)
                value += env[t]
        env[name] = value
        lines.append(f"{name} = {' + '.join(parts)}")
    for name, value in env.items():
        text = "\n".join([*lines, f"db_pwd = {name}"])
        assert reached(text) == sorted(set(value))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="pwd=:+'\"\\\n ()[]<>/|a1$_{}#", max_size=60))
def test_any_text_gives_spans_within_it(text):
    for s in S.scan_text("pwd" + text, 0)[1]:
        assert 0 <= s.start < s.end <= len(text) + 3


@pytest.mark.parametrize("line", ["x" * 10**6 + ":pwd", "pwd:" * 80_000, '\\"' * 500_000 + "pwd=", "pwd = 'a' + " * 30_000, '"""' * 300_000 + "pwd=1", "<pwd>" * 200_000, "pwd: |\n" * 120_000, "a = a + a\n" * 40_000 + "pwd = a", "token=abcdefgh1 " * 30_000, "pwd(" * 250_000 + "=", " " * 10**6 + "pwd=1"])
def test_long_lines_cost_no_more_than_others(line):
    begun = time.process_time()
    S.scan_text(line)
    assert time.process_time() - begun < 6
