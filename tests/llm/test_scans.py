"""Secrets, quality, licences: row by row."""

import hashlib
import re
import textwrap
import time
from collections import Counter

import pytest

from quarry.llm import licenses, quality, secrets
from tests.llm.helpers import SCHEMA, by_id, frame, prose, rows, words


def base_of(text):
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text, re.I | re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if m.end() - m.start() >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if m.end() - m.start() >= 32]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secrets_base(spark, sf_dir):
    for docs in (frame(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
        got = Counter()
        want = Counter()
        for (i, t), n in texts.items():
            b = base_of(t)
            c = Counter(k for k, *_ in b)
            want[(i, c["assign"], c["access"], c["hex"], hashlib.sha256(",".join(f"{k}:{x}:{y}" for k, x, y in b).encode()).hexdigest())] += n
        for r in secrets.find(docs).collect():
            got[(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"])] += 1
            spans = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in r["spans"].split(",") if x)]
            assert spans == sorted(spans, key=lambda x: (x[1], secrets.KINDS.index(x[0]), x[2]))
        assert got == want


@pytest.mark.parametrize(("text", "found"), [
    ('k = "Zx9kfj39fkQ1"\nclient_secret = k', ["Zx9kfj39fkQ1"]), ('a = "Zx9kfj39fkQ1"\nb = a\nauth_token: b', ["Zx9kfj39fkQ1"]), ('private_key = "Zx9kf" + "j39fkQ1Lm3"', ["Zx9kf", "j39fkQ1Lm3"]), ('{"dbPassword": "p4ssW0rdXy"}', ["p4ssW0rdXy"]), ("DB_PASSWD=Zx9kfj39fkQ1", ["Zx9kfj39fkQ1"]),
    ('password = "changeme"', []), ("password_file = /etc/passwords", []), ('name = "Zx9kfj39fkQ1"', []), ("note: the token is lost", []), ('if password == "Zx9kfj39fkQ1":', []), ("", []), ("=" * 5000, []), ("a=" * 3000, []),
    ("p = p\npassword = p", []), ('k = "Zx9kfj39fkQ1"\nk = 1\nsecret_value = k', []),
])
def test_named_secrets(text, found):
    assert [text[s.start : s.end] for s in secrets.named_spans(text)] == found


@pytest.mark.parametrize(("text", "found"), [
    ('db_password: str = "S3cr3tValue99"', ["S3cr3tValue99"]), ("const apiToken: string = 'S3cr3tValue99';", ["S3cr3tValue99"]), ('let api_key: &\'static str = "S3cr3tValue99";', ["S3cr3tValue99"]), ('val authToken: String? = "S3cr3tValue99"', ["S3cr3tValue99"]), ('password: Optional[str]  = "S3cr3tValue99"', ["S3cr3tValue99"]), ('def f(password: str="S3cr3tValue99", n: int = 1):', ["S3cr3tValue99"]),
    ('var password string = "S3cr3tValue99"', ["S3cr3tValue99"]), ('password string = "S3cr3tValue99"', ["S3cr3tValue99"]), ('String password = "S3cr3tValue99";', ["S3cr3tValue99"]), ('var token []string = []string{"S3cr3tValue99", "An0therValue1"}', ["S3cr3tValue99", "An0therValue1"]),
    ('greeting: str = "Inn0centValue1"\ndb_password: str = "S3cr3tValue99"', ["S3cr3tValue99"]), ('title: str = "Inn0centValue1"\npassword: str = load()', []),
    ('password = [\n  "S3cr3tValue99",\n  "An0therValue1",\n]', ["S3cr3tValue99", "An0therValue1"]), ("password: [S3cr3tValue99, An0therValue1]", ["S3cr3tValue99", "An0therValue1"]), ('password = SecretStr("S3cr3tValue99")', ["S3cr3tValue99"]), ('password = os.getenv("APP_PASSWORD1", "S3cr3tValue99")', ["S3cr3tValue99"]), ('password = env("APP", default="S3cr3tValue99")', ["S3cr3tValue99"]), ('let password = String::from("S3cr3tValue99");', ["S3cr3tValue99"]), ('password = """S3cr3tValue99"""', ["S3cr3tValue99"]), ("client_secret = \'\'\'\n  S3cr3tValue99\n\'\'\'", ["S3cr3tValue99"]),
    ('k = "S3cr3tValue99"\npassword = f(k)', ["S3cr3tValue99"]), ('password = config["db_password"]', []), ('password = read_secret("db_password")', []), ("password: str", []), ("token: c2VjcmV0dmFsdWU=", ["c2VjcmV0dmFsdWU="]), ("password = [", []), ("password = f(a)b)", []),
])
def test_typed_and_nested_secrets(text, found):
    assert [text[s.start : s.end] for s in secrets.named_spans(text)] == found
    assert not any(x in secrets.redact(text) for x in found)


@pytest.mark.parametrize(("text", "found"), [
    ('private_key = ("Zx9kf" "j39fk"\n  "Q1Lm3")', ["Zx9kf", "j39fk", "Q1Lm3"]), ('a = "Zx9kf"\nprivate_key = a + "j39fkQ1"', ["Zx9kf", "j39fkQ1"]), ('private_key = "Zx9kf" \\\n  "j39fkQ1"', ["Zx9kf", "j39fkQ1"]), ("$password = 'Zx9kf' . 'j39fkQ1';", ["Zx9kf", "j39fkQ1"]),
    ("db:\n  password: |\n    S3cr3tValue99\n\n    An0therValue1\n  user: Zx9kfj39fkQ1", ["S3cr3tValue99", "An0therValue1"]), ("private_key: >-\n  S3cr3tValue99\nname: Zx9kfj39fkQ1", ["S3cr3tValue99"]),
    ("<db><password>S3cr3tValue99</password><user>Zx9kfj39fkQ1</user></db>", ["S3cr3tValue99"]), ('<string name="api_key">S3cr3tValue99</string>', ["S3cr3tValue99"]), ("<key>Password</key>\n<string>S3cr3tValue99</string><string>Zx9kfj39fkQ1</string>", ["S3cr3tValue99"]), ('<add password="S3cr3tValue99"/>', ["S3cr3tValue99"]),
    ('message = "the password = none"\nname = "Zx9kfj39fkQ1"', []), ('url = "Server=x;Password=S3cr3tValue99;"', ["S3cr3tValue99"]), ("https://x.org/?user=a&api_token=S3cr3tValue99&x=1", ["S3cr3tValue99"]), ("password =  # token: the one that is used\n", []), ('x = 1  # password = "S3cr3tValue99"', ["S3cr3tValue99"]), ("it's there; password: S3cr3tValue99 isn't", ["S3cr3tValue99"]),
    ("password = ", []), ('password = "', []), ("password: |", []), ("<password>", []), ("password: |\n", []),
])
def test_lexed(text, found):
    assert [text[s.start : s.end] for s in secrets.named_spans(text)] == found
    assert not any(x in secrets.redact(text) for x in found)


def test_spans_of_made_up_files():
    """Files put together of assignments in many syntaxes, of which it is known what is a secret: all of those and nothing else."""
    import random

    rng = random.Random(4)
    forms = ['{n} = "{v}"', "{n}: {v}", '"{n}": "{v}",', "{n} => '{v}'", '{n}: str = "{v}"', 'config["{n}"] = "{v}"', "<{n}>{v}</{n}>", '<add {n}="{v}"/>', "{n}: |\n  {v}", 'let {n} = String::from("{v}");', 'var {n} string = "{v}"', "export {n}={v}", 'k{i} = "{v}"\n{n} = k{i}', '{n} = "{a}" + "{b}"', "{n} := `{v}`", '# {n} = "{v}"']
    words = ["the quick brown fox", "it's not here, isn't it?", "a <b> c </b>", "x == y && z != w", "see http://x.org/a?b=c", "if (a) { b(); }", "", '"quoted"']
    for _ in range(200):
        lines, want = [], []
        for i in range(rng.randrange(1, 12)):
            value = "".join(rng.choice("abcdefghkmnpqrstuvw") + rng.choice("ABCDEFGHKMNP") + rng.choice("23456789") for _ in range(6))
            secret = rng.random() < 0.5
            name = rng.choice(["db_password", "apiToken", "client_secret", "privateKey"] if secret else ["title", "user", "colour", "max_items"])
            form = rng.choice(forms)
            lines.append(form.format(n=name, v=value, i=i, a=value[:9], b=value[9:]))
            want += ([value[:9], value[9:]] if "{a}" in form else [value]) if secret else []
            lines += rng.choices(words, k=rng.randrange(3))
        text = "\n".join(lines)
        assert [text[x.start : x.end] for x in secrets.named_spans(text)] == want, text


def test_lexing_takes_time_in_proportion():
    """What is gone through again and again would take minutes here."""
    for part in ("a=", "k=v&", 'a="', "a='b", "a=[", 'password=["x" ', "a: |\n", "<a>", "<a b=", "a=b+", "a:b<", "a=f(", '"\\"', "'''", "a = b = ", ": a | ", "a=b ", 'p="x"+', "`", "a: b[", "# ", "a:\n"):
        text = part * (600_000 // len(part))
        began = time.process_time()
        secrets.scan(text)
        assert time.process_time() - began < 12, part


def test_clean(spark):
    docs = frame(spark)
    out = secrets.clean(docs)
    assert out.schema == docs.schema and out.count() == docs.count()
    got = by_id(out.collect())
    for i, rs in by_id(docs.collect()).items():
        for r in rs:
            if not secrets.scan(r["text"] or "")[1]:
                assert r in got[i]
    text = next(r["text"] for r in out.collect() if r["text"] and "client_secret" in r["text"])
    assert not any(x in text for x in ("hunter2", "Zx9kfj39fkQ1", "AKIA", "deadbeef")) and text.startswith('password = "[secret]"')
    assert all(r["n_chars"] == len(r["text"]) for r in out.collect() if r["text"] and r["n_chars"] not in (None, 5))


def quality_of(text):
    w = words(text)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, dup, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)


def test_quality(spark, sf_dir):
    for docs in (frame(spark), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        want = Counter((r["doc_id"], *quality_of(r["text"])) for r in docs.collect())
        got = quality.score(docs, ["doc_id"]).collect()
        assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
        assert not any(r["kept"] and r["base_failed"] for r in got)
        short = Counter()
        for r in docs.collect():
            w = words(r["text"])
            if len(w) <= 250:
                longest = longest_of(w)
                inside = {j for i, n in enumerate(longest) if n >= quality.REPEAT_WORDS for j in range(i, i + n)}
                top = max(longest, default=0)
                short[(r["doc_id"], len(w), len(inside), top, not quality_of(r["text"])[-1] and len(inside) <= quality.MOST_COVERED * len(w) and top <= quality.LONGEST_REPEAT)] += 1
        assert Counter((r["doc_id"], r["n_words"], r["n_covered_words"], r["longest_repeat"], r["kept"]) for r in got if r["n_words"] <= 250) == short


def longest_of(w):
    n = len(w)
    out = []
    for i in range(n):
        out.append(max((next((k for k in range(n) if i + k >= n or j + k >= n or w[i + k] != w[j + k]), 0) for j in range(n) if j != i), default=0))
    return out


def test_suffix_arrays():
    import random

    import numpy as np

    rng = random.Random(5)
    docs = [[rng.randrange(3) for _ in range(rng.randrange(40))] for _ in range(30)] + [[1] * 50, [], [2]]
    doc = np.repeat(np.arange(len(docs)), [len(d) for d in docs])
    got = quality.longest_repeats(doc, np.array([x for d in docs for x in d]))
    assert got.tolist() == [x for d in docs for x in longest_of(d)]


def test_filter(spark):
    docs = frame(spark)
    kept = {(r["doc_id"]) for r in quality.score(docs, ["doc_id"]).where("kept").collect()}
    out = quality.filter_documents(docs)
    assert out.schema == docs.schema and {r["doc_id"] for r in out.collect()} == kept and kept >= set(range(12))


def license_of(text):
    units = (text or "").split("\n") if text is not None else []
    units += [text] * (len(units) > 1)
    best, n = (0.0, None), 0
    for unit in units:
        w = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in unit))
        u = set(zip(w, w[1:]))
        tops = [(2 * len(u & (b := {tuple(x.split()) for x in bs})) / (len(u) + len(b)), -k, name) for k, (name, _, bs) in enumerate(licenses.template_bigrams()) if u]
        if tops and max(tops)[0] >= 0.8:
            n += 1
            best = max(best, (max(tops)[0], max(tops)[1:]), key=lambda x: (x[0], x[1] and x[1][0]))
    return n, best[1] and best[1][1], best[1] and round(best[0], 6)


def test_licenses(spark, sf_dir):
    more = [(1000 + i, t, *rows()[0][2:]) for i, t in enumerate(x for given in licenses.TEMPLATES.values() for x in given)]
    docs = [frame(spark), spark.createDataFrame(more, SCHEMA), spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for d in docs:
        want = Counter((r["doc_id"], *license_of(r["text"])) for r in d.collect())
        assert Counter((r["doc_id"], r["n_matches"], r["license"], r["dice"]) for r in licenses.find(d).collect()) == want


def windows_of(text):
    """All windows of words, the best at each place and template: what counts, and the best Dice and licence."""
    given = [re.findall("[a-z0-9]+", x) for x in text.lower().split("\n")]
    w, line = sum(given, []), [i for i, x in enumerate(given) for _ in x]
    g, found = list(zip(w, w[1:])), []
    matched = {i for i, x in enumerate(text.split("\n")) if license_of(x)[0]}
    for k, (name, _, bs) in enumerate(licenses.template_bigrams()):
        b = {tuple(x.split()) for x in bs}
        for i in range(len(g)):
            tops = [(2 * len(u & b) / (len(u) + len(b)), -j) for j in range(i + 1, min(len(g), i + int(len(b) * 1.5 + 1e-9)) + 1) if (u := set(g[i:j]))] if g[i] in b else []
            if tops and max(tops)[0] >= 0.8:
                found.append((i, -max(tops)[0], k, -max(tops)[1] - 1, name))
    free, n, less, end = sorted(x for x in found if not matched & set(range(line[x[0]], line[x[3] + 1] + 1))), 0, 0.0, -1
    for start, d, _, to, _ in free:
        n += start > end
        if start > end or d < less:
            less, end = d, to
    top = min(((d, k, name) for _, d, k, _, name in found), default=(0.0, 0, None))
    return n, top[2], round(-top[0], 6)


def test_license_windows(spark):
    code = "\n".join(f"    value_{i} = compute(value_{i - 1}, {i})" for i in range(60))
    wrapped = lambda x: "\n".join("# " + y for y in textwrap.wrap(x, 72))
    long = [(name, x) for name, given in licenses.TEMPLATES.items() for x in given if len(x) > 72]
    cases = [(name, "#!/bin/sh\n" + wrapped(x) + "\n\n" + code) for name, x in long]
    cases += [(name, f"Some words before, of which there are many here. {x} And then the text goes on for a good while, as prose does.") for name, given in licenses.TEMPLATES.items() for x in given]
    cases += [("mit", "First this one: released under the MIT License. Released under the MIT License. " + prose(3, 40)), ("gpl-2.0", wrapped(long[-1][1] + " " + prose(1, 9)) + "\n" + wrapped(licenses.TEMPLATES["gpl-2.0"][1]) + "\n" + code)]
    cases += [(None, "The licence is under discussion; the terms of the version 2 may be public.\n" + code), ("apache-2.0", "Licensed under the Apache License, Version 2.0.\n" + prose(2, 30) + " Released under the MIT License. " + prose(4, 30))]
    docs = spark.createDataFrame([(i, t, *rows()[0][2:]) for i, (_, t) in enumerate(cases)], SCHEMA)
    got = {r["doc_id"]: r for r in licenses.find(docs).collect()}
    for i, (name, text) in enumerate(cases):
        units, inside = license_of(text), windows_of(text)
        best = units[1:] if units[0] and units[2] >= inside[2] else inside[1:] if inside[1] else (None, None)
        assert (got[i]["n_matches"], got[i]["license"], got[i]["dice"]) == (units[0] + inside[0], *best), text
        assert (name is None) == (got[i]["n_matches"] == 0) and (i < len(cases) - 4) <= (got[i]["license"] == name), (name, got[i], text)
    assert got[len(cases) - 4]["n_matches"] == 2 and got[len(cases) - 1]["n_matches"] == 2


def test_empty(spark):
    none = frame(spark, [])
    for out in (secrets.find(none), secrets.clean(none), quality.score(none, ["doc_id"]), quality.filter_documents(none), licenses.find(none)):
        assert out.count() == 0
