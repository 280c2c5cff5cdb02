import hashlib
import random
import re
import time

from helpers import corpus, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from sievework.llm import pii

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    found = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub("[ -]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found)


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="ab1204@@..++-- ()%_\n٣é", max_size=60))
def test_base_is_the_four_expressions(text):
    assert pii.base_spans(text) == brute(text)


def test_base_samples():
    text = "x a.b@c.d@e.fg 4111 1111 1111 1111, 1.2.3.4.5.6.7.8 +1 (555) 010-9999 and 256.1.1.1 0000300.1.1.1 000.001.1.1"
    assert pii.base_spans(text) == brute(text) and len(brute(text)) >= 5
    for unit, n in (("1", 50_000), ("@", 20_000), ("+1", 20_000), ("1.", 20_000), ("a@b.", 10_000), ("a", 50_000)):
        assert pii.base_spans(unit * 300 + "@") == brute(unit * 300 + "@")
        began = time.time()  # the expressions themselves take quadratic time on some of these
        pii.instances(unit * n + "@")
        assert time.time() - began < 10


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"words here and contact number: +1 (555) 010-{1000 + i} then more of the text 7 of {i}") for i in range(30)]
    rows += [(100, "please use contact number: 555-0199x7 today"), (101, "the room of 12345 is not an identifier"), (102, None), (103, ""), (100, "please use contact number: 555-0199x7 today")]
    out = {}
    for r in pii.find(documents(spark, rows)).collect():
        out.setdefault(r["doc_id"], []).append((r["base_"], r["spans_"], r["spans"]))
    assert [tuple(s) for s in out[100][0][1]] == [(27, 4, 37)] and len(out[100]) == 2 and out[100][0][0] == []
    assert out[101][0][1] == [] and out[102][0][1] == [] and out[103][0][1] == []
    assert all(len(out[i][0][1]) == 1 and out[i][0][2] == "x" for i in range(30))


def test_no_contexts_without_evidence(spark):
    rows = corpus(40) + [(900, "mail me@example.com now"), (901, "mail 12345x now")]
    found = {r["doc_id"]: r["spans_"] for r in pii.find(documents(spark, rows)).collect()}
    assert len(found[900]) == 1 and found[901] == []
    assert pii.find(documents(spark, [])).count() == 0


def test_redaction(spark):
    rows = [(1, "write to a@b.cd or +49 30 1234567."), (2, None), (3, "nothing")]
    got = {r["doc_id"]: r["text"] for r in pii.find(documents(spark, rows), redacted=True).collect()}
    assert got == {1: "write to <EMAIL> or <PHONE>.", 2: None, 3: "nothing"}
    assert pii.redact("abcdef", [(1, 0, 4), (2, 3, 5)]) == "a<EMAIL>f"


def test_unrelated_documents_take_no_identifiers_away(spark, monkeypatch):
    monkeypatch.setattr(pii, "SHARE", 10, raising=False)  # a share of the input that support once rose with
    rows = [(i, f"please use contact number: +1 (555) 010-{1000 + i} today") for i in range(6)] + [(100, "please use contact number: 555-0199x7 today")]
    rows += [(200 + i, f"w{i}q v{i}q u{i}@example.com") for i in range(200)]
    found = {r["doc_id"]: [tuple(s) for s in r["spans_"]] for r in pii.find(documents(spark, rows)).collect()}
    assert found[100] == [(27, 4, 37)]


def test_contexts_too_many_to_send_are_joined(spark, monkeypatch):
    rows = [(i, f"please use contact number: +1 (555) 010-{1000 + i} today") for i in range(6)]
    rows += [(100, "please use contact number: 555-0199x7 today"), (100, "please use contact number: 555-0199x7 today"), (101, "the room of 12345"), (102, None), (103, "")]
    sent = sorted(pii.find(documents(spark, rows), redacted=True).collect(), key=str)
    monkeypatch.setattr(pii, "FEW", 0)
    joined = sorted(pii.find(documents(spark, rows), redacted=True).collect(), key=str)
    assert sent == joined and sum("<ID>" in (r["text"] or "") for r in joined) == 2


def test_contexts_are_whole_words(spark):
    for text, word in (("my account number (AB12345)", "AB"), ('the "account number" <a@b.cd>', "a@"), ("see mailto:a@b.cd", "a@"), ("x account" + " " * 500 + "number a@b.cd", "a@"), ("y" * 300 + " number 12", "12"), ("a@b.cd", "a@")):
        expected = ["^", "^", *text.lower().split()][:-1][-2:]
        assert pii.context(text, text.index(word)) == " ".join(expected)
    many = "k " + "1.2.3.4," * 20_000 + " one two 7x8"
    starts = [a for a, _, _ in pii.base_spans(many)] + [len(many) - 3]
    assert set(pii.contexts(many, starts)) == {"^ k", "one two"}

    rows = [(i, f"my account number (user{i}@example.com) is here") for i in range(8)] + [(20 + i, f'say "key="{i}" link <u{i}@example.org>') for i in range(8)]
    rows += [(100, "my account number (AB12345) is here"), (101, "my account number [AB12346] is here"), (102, "my account number" + " " * 300 + "AB12347 is here"), (103, 'link "AB12348"')]
    found = {r["doc_id"]: [r["text"][a:z] for a, _, z in r["spans_"]] for r in pii.find(documents(spark, rows)).collect()}
    assert [found[i] for i in range(100, 104)] == [["AB12345"], ["AB12346"], ["AB12347"], []]


def test_patterns_of_an_instance():
    text = 'set api.token = "deadbeef0123456789" and mail: a@b.cd, x-ID12:34 {"Key": \'9f-Zz1-aaa-4444\'} é12ab 12é'
    got = {text[i.start : i.end]: (i.kind, i.seed, i.patterns[1:]) for i in pii.instances(text)}
    assert got == {
        "deadbeef0123456789": (pii.ID, True, ["Kapi.token", "Sh18"]),
        "a@b.cd": (0, True, ["Kmail"]),
        "x-ID12:34": (pii.ID, False, []),
        "9f-Zz1-aaa-4444": (pii.ID, False, ["Kkey", "Sh2-x3-a3-d4"]),
    }
    assert pii.shape("0123456789ab") == "h12" and pii.shape("123456789012") is None and pii.shape("a1") is None
    assert pii.candidates("x4111111111111111y", pii.base_spans("x4111111111111111y")) == [(0, 18)]  # holds a card number


def brute_marks(texts, confident=0.6, support=5):
    """The patterns to trust, with their confidence, by dictionaries over all texts."""
    edges, seeds, size = {}, set(), {}
    for text in texts:
        own = pii.instances(text)
        words = ["^", "^", *text.lower().split()]
        for a, b in zip(words, words[1:]):
            size[f"L{a} {b}"] = size.get(f"L{a} {b}", 0) + 1
        for i in own:
            for p in i.patterns:
                edges.setdefault(p, []).append(text[i.start : i.end])
            if i.seed:
                seeds.add(text[i.start : i.end])
        for start, name in pii.assignments(text).items():
            if start not in {i.start for i in own}:
                edges.setdefault(f"K{name}", []).append(None)
    sure, trusted = dict.fromkeys(seeds, 1.0), {}
    while True:
        new = {}
        for p, values in edges.items():
            share = sum(sure.get(v, 0) for v in values) / max(len(values), size.get(p, 0))
            if p not in trusted and share >= confident and len({v for v in values if sure.get(v)}) >= support:
                new[p] = share
        if not new:
            return trusted
        trusted |= new
        for p, c in new.items():
            for v in edges[p]:
                if v is not None:
                    sure[v] = max(sure.get(v, 0), c)


def bootstrapped(seed=1):
    """Texts in which keys, shapes and words lead from seeds to others over several rounds, beside noise."""
    rng = random.Random(seed)
    code = lambda n, abc="0123456789abcdef": "a1" + "".join(rng.choices(abc, k=n - 2))
    texts = []
    for i in range(12):
        texts += [f'some words token = "{code(32)}" more' for _ in range(4)]
        texts.append(f"auth: {code(32)} here")  # of the shape that the seeds have
        texts.append(f"auth: {code(20, 'qrstuvwxyz0123') if i < 3 else code(32)} here")  # assigned to the name that such values are
        texts.append(f"order number {code(9)} of {i}")
        texts.append(f"version = {rng.randint(1, 9)}.{i}.77 and build = none")
        texts.append(f"write to u{i}@example.com or visit room {i}404")
    for i in range(6):
        texts.append(f"account holder user{i}@x.org then account holder {i}ZX{i}900")
        texts.append(f"secret = {code(17, 'qrstuvw0123')}" if i % 2 else "secret = none")
    rng.shuffle(texts)
    return [*texts, *texts[:20]]


def test_scores_are_those_of_brute_force(spark):
    texts = bootstrapped()
    expected = brute_marks(texts)
    got = {r["pattern"]: r["confidence"] for r in pii.trusted_patterns(spark.createDataFrame([(t,) for t in texts], "text string").repartition(5)).collect()}
    assert set(got) == set(expected) and all(abs(got[p] - c) < 1e-9 for p, c in expected.items())
    assert expected["Ktoken"] == 1 > expected["Sh32"] > expected["Kauth"] >= 0.6  # one led to the next
    rows = pii.find(documents(spark, list(enumerate(texts)))).collect()
    for r in rows:
        want = {(i.start, i.end) for i in pii.instances(r["text"]) if i.kind == pii.ID and (i.seed or set(i.patterns) & set(expected))}
        assert {(a, z) for a, k, z in r["spans_"] if k == pii.ID} == want
    found = {r["text"][a:z] for r in rows for a, k, z in r["spans_"] if k == pii.ID}
    assert len(found) >= 12 * 6 and not any(v.startswith("room") or v.endswith("404") for v in found)


def test_seeds_are_found_however_few(spark):
    rows = [(1, 'x token = "04dbebab91ab85687d33" y'), (2, "PASSWORD=Zz9zz9zz9zz9zz9zz9!!"), (3, "token = short1"), (4, "tokens = 04dbebab91ab85687d33")]
    found = {r["doc_id"]: [r["text"][a:z] for a, _, z in r["spans_"]] for r in pii.find(documents(spark, rows)).collect()}
    assert found == {1: ["04dbebab91ab85687d33"], 2: ["Zz9zz9zz9zz9zz9zz9"], 3: [], 4: []}


def test_query_follows_its_contract(spark, tmp_path):
    rows = [*corpus(30), *[(500 + i, t) for i, t in enumerate(bootstrapped(2))], (900, "a@b.cd 1.2.3.4 4111 1111 1111 1111 +1 (555) 010-9999")]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted(((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.op1_pii(spark, str(tmp_path)).collect()), key=str)
    expected = []
    for i, t in rows:
        spans = brute(t or "")
        told = ",".join(f"{pii.KINDS[k]}:{a}:{z}" for a, k, z in spans)
        expected.append((i, *[sum(k == n for _, k, _ in spans) for n in range(4)], hashlib.sha256(told.encode()).hexdigest()))
    assert got == sorted(expected, key=str)
