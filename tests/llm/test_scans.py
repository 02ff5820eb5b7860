import hashlib
import random
import re
from datetime import date, timedelta

from corpusloom.llm import line_dedup, pii, secret_scan
from pyspark.sql import functions as F


def base_spans(t):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        if len(m[2]) >= 8:
            found.append((m.start(), 0, "assign", m.end()))
    for kind, rank, pattern, least in (("access", 1, r"AKIA[A-Z0-9]+", 16), ("hex", 2, r"[0-9a-f]+", 32)):
        found += [(m.start(), rank, kind, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= least]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


TEXTS = [
    "", None, "token = abcdefgh1", "secret: token: abcdefghij", "PASSWORD='x' passwd=\"longenough99\"", "é😀 api_key=12345678 AKIA" + "A" * 12, "AKIAAKIA" + "B" * 9, "AKIASHORT " + "0" * 32,
    "a" * 31 + " " + "f" * 40 + "g" + "ab" * 16, "token=" + "ab" * 20, "apikey : 'deadbeefdeadbeefdeadbeefdeadbeef'", "x" * 50_000 + " secret=" + "z" * 9, "token=a token=bbbbbbbbb\ntoken=ccccccccc",
]


def test_secrets(spark):
    rng = random.Random(7)
    texts = TEXTS + ["".join(rng.choice(["token", "=", " ", "abcdefgh", ":", "AKIA", "0123456789abcdef", "A" * 13, "é", "secret", '"']) for _ in range(40)) for _ in range(60)] + ["token = abcdefgh1"] * 5
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, blob string, found int")
    got = {r.doc_id: r for r in secret_scan.report(secret_scan.scan_paths(df)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        assert got[i].spans == ",".join(want), (t, want)
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex"))


def test_ledger(spark):
    from corpusloom.llm.common import materialize

    rules = secret_scan.RULES
    one = spark.createDataFrame([(1, "token = abcdefgh1"), (2, "nothing")], "doc_id long, text string")
    first = secret_scan.pending_blobs(one, "text", rules, None)
    ledger = materialize(secret_scan.extend_ledger(None, first, secret_scan.scan_blobs(first, rules)), "ledger")
    more = one.union(spark.createDataFrame([(3, "token = abcdefgh1"), (4, "secret=newnewnew")], "doc_id long, text string"))
    pending = secret_scan.pending_blobs(more, "text", rules, ledger)
    assert [r.text for r in pending.collect()] == ["secret=newnewnew"]
    got = {r.doc_id: [s["rule"] for s in r.found] for r in secret_scan.scan_paths(more, ledger=ledger).collect()}
    assert got == {1: ["assign"], 2: [], 3: ["assign"], 4: ["assign"]}
    raised = (*rules[:2], secret_scan.Rule("hex", r"[0-9a-f]{32,}", version="2"))
    again = secret_scan.pending_blobs(more, "text", raised, ledger)
    assert {r.text: len(r.pending) for r in again.collect()} == {"token = abcdefgh1": 1, "nothing": 1, "secret=newnewnew": 3}
    book = secret_scan.extend_ledger(ledger, pending, secret_scan.scan_blobs(pending, rules))
    assert book.count() == 3 and secret_scan.pending_blobs(more, "text", rules, book).count() == 0
    assert secret_scan.scan_paths(one.limit(0)).count() == 0


def test_raised_version(spark):
    from corpusloom.llm.common import materialize

    docs = spark.createDataFrame([(1, "a" * 32), (2, "b" * 40), (3, "token = abcdefgh1 " + "c" * 40)], "doc_id long, text string")
    first = secret_scan.pending_blobs(docs, "text", secret_scan.RULES, None)
    ledger = materialize(secret_scan.extend_ledger(None, first, secret_scan.scan_blobs(first)), "ledger")
    raised = (secret_scan.Rule("hex", r"[0-9a-f]{40,}", version="2"), *secret_scan.RULES[:2])
    pending = secret_scan.pending_blobs(docs, "text", raised, ledger)
    book = materialize(secret_scan.extend_ledger(ledger, pending, secret_scan.scan_blobs(pending, raised)), "ledger")
    want = {1: [], 2: [("hex", 0, 0, 40)], 3: [("assign", 1, 0, 17), ("hex", 0, 18, 58)]}
    for known in (ledger, book):
        got = secret_scan.scan_paths(docs, rules=raised, ledger=known).collect()
        assert {r.doc_id: [(s["rule"], s["rank"], s["start"], s["end"]) for s in r.found] for r in got} == want
    # the same scan entered twice changes nothing
    assert secret_scan.extend_ledger(book, pending, secret_scan.scan_blobs(pending, raised)).exceptAll(book).count() == 0


def test_lines(spark, monkeypatch):
    html = lambda *ls: "<html><head><title>t</title></head><body><script>x<p>y</p></script>" + "".join(f"<p>{x}</p>" for x in ls) + "</body></html>"
    rows = [(i, "http://www.a.com/x", html("menu", f"own {i}", "menu", "a &amp; b")) for i in range(6)] + [(10, "http://b.com", html("menu", "solo")), (11, None, html("menu")), (12, "nonsense", None), (13, "http://A.com:80/", html("menu")), (14, "http://user@www.a.com?q", html("menu"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lines", F.lit(1)).withColumn("host", F.lit("h"))
    for bound in (16 << 20, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
        got = {r.page_id: r for r in line_dedup.line_dedup(df, ratio=0.5).collect()}
        assert got[0].text == "own 0" and (got[0].n_lines, got[0].n_dropped, got[0].host) == (4, 3, "www.a.com")
        assert got[14].text == "" and got[10].text == "menu\nsolo" and got[11].text == "menu" and got[11].host is None and got[12].n_lines == 0 and got[13].text == "menu"
    assert line_dedup.line_dedup(df.limit(0)).count() == 0


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_pii(spark):
    cases = [
        "call +1 (017) 555-7713 now", "card 4845168114407329, again 4845-1681-1440-7329", "bad 4845168114407328", "ip 97.51.17.173 and 1.2.3.4.5 or 999.1.1.1", "mail a.b+c@mail7.example.com!", "born 1999-02-28 or 02/28/1999 or 28.02.1999, never 1999-02-30",
        "ssn 123-45-6789 not 000-45-6789", "", None, "é😀 nothing", "12 4845168114407329", "x@y", "+1 (017) 555-7713",
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(cases)], "doc_id long, text string, n_card string")
    got = {r.doc_id: r for r in pii.pseudonymised(df, "key").collect()}
    t = {i: r.text for i, r in got.items()}
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} now", t[0]) and t[0] != cases[0] and t[0][5:-4] == t[12]
    a, b = re.fullmatch(r"card (\d{16}), again ([\d-]{19})", t[1]).groups()
    assert luhn(a) and a == b.replace("-", "") and a != "4845168114407329" and t[10] == f"12 {a}"
    assert t[2] == cases[2] and t[7] == t[8] == "" and t[9] == cases[9] and t[11] == "x@y"
    assert re.fullmatch(r"ip (\d+\.){3}\d+ and 1.2.3.4.5 or 999.1.1.1", t[3]) and "97.51.17.173" not in t[3] and all(int(x) < 256 for x in t[3].split()[1].split("."))
    assert re.fullmatch(r"mail u[0-9a-f]{16}@d[0-9a-f]{16}\.example!", t[4])
    iso, us, eu = re.fullmatch(r"born (\S+) or (\S+) or (\S+), never 1999-02-30", t[5]).groups()
    assert iso == f"{us[6:]}-{us[:2]}-{us[3:5]}" == f"{eu[6:]}-{eu[3:5]}-{eu[:2]}" and iso != "1999-02-28" and date.fromisoformat(iso)
    assert re.fullmatch(r"ssn \d{3}-\d\d-\d{4} not 000-45-6789", t[6]) and "123-45-6789" not in t[6]
    assert (got[1].n_card, got[3].n_ip, got[5].n_date, got[6].n_ssn, got[0].n_phone, got[4].n_email) == (2, 1, 3, 1, 1, 1)
    assert pii.pseudonymised(df.limit(0), "key").count() == 0
    other = {r.doc_id: r.text for r in pii.pseudonymised(df, "other").collect()}
    assert other[0] != t[0]


def test_permutation(spark):
    x = spark.range(11 * 7).select(pii.permuted(F.col("id") % 11, F.floor(F.col("id") / 11), F.lit(11), F.lit(7), F.lit("k"), "t").alias("p")).collect()
    assert len({tuple(r.p) for r in x}) == 77 and all(0 <= r.p.l < 11 and 0 <= r.p.r < 7 for r in x)
    days = [str(date(1900, 1, 1) + timedelta(days=k)) for k in range(0, 73049, 37)]
    got = [r[0] for r in spark.createDataFrame([(d,) for d in days], "d string").select(pii._date(F.col("d"), F.lit("k"))).collect()]
    assert len(set(got)) == len(days) and all("1900-01-01" <= d <= "2099-12-31" for d in got)


def digits(t):
    return re.sub("[^0-9]", "", t)


def feistel(left, right, a, b, key, tweak):
    for i in range(8):
        half = right if i % 2 == 0 else left
        f = int(hashlib.sha256(f"{key}|{tweak}|{i}|{a}|{b}|{half}".encode()).hexdigest()[:15], 16)
        left, right = ((left + f % a) % a, right) if i % 2 == 0 else (left, (right + f % b) % b)
    return left, right


def refilled(t, ds):
    ds = iter(ds)
    return "".join(next(ds) if c.isdigit() else c for c in t)


def number(d, key, tweak):
    h = len(d) // 2
    a, b = feistel(int(d[:h]), int(d[h:]), 10**h, 10 ** (len(d) - h), key, tweak)
    return f"{a:0{h}d}{b:0{len(d) - h}d}"


def national(d, key):
    area, exchange, line = int(d[:3]), int(d[3:6]), int(d[6:])
    (la, sa), (le, se) = ((200, 800) if x >= 200 else (0, 200) for x in (area, exchange))
    x, y = feistel(area - la, (exchange - le) * 10_000 + line, sa, se * 10_000, key, "phone")
    return f"{x + la:03d}{y // 10_000 + le:03d}{y % 10_000:04d}"


OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
DAY = [(r"((?:19|20)\d\d)([-/])(0[1-9]|1[0-2])\2(0[1-9]|[12]\d|3[01])", (1, 3, 4)), (r"(0[1-9]|1[0-2])/(0[1-9]|[12]\d|3[01])/((?:19|20)\d\d)", (3, 1, 2)), (r"(0[1-9]|[12]\d|3[01])\.(0[1-9]|1[0-2])\.((?:19|20)\d\d)", (3, 2, 1))]


def one(t, at, key):
    """(end, kind, pseudonym) of what begins at a place, the first kind that matches; kind is None for what isn't valid."""
    before, rest = t[:at], t[at:]
    fits = lambda p: re.match(p, rest, re.A)
    if not re.search(r"[A-Za-z0-9._%+-]\Z", before) and (m := fits(r"([A-Za-z0-9._%+-]+)@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)")):
        u, d = (hashlib.sha256(f"{key}|email|{x.lower()}".encode()).hexdigest()[:16] for x in m.groups())
        return m.end(), "email", f"u{u}@d{d}.example"
    if not re.search(r"[0-9.]\Z", before) and (m := fits(rf"(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])")):
        a, b, c, d = map(int, m[0].split("."))
        x, y = feistel(a * 256 + b, c * 256 + d, 65536, 65536, key, "ip")
        return m.end(), "ip", f"{x // 256}.{x % 256}.{y // 256}.{y % 256}"
    for p, places in DAY if not re.search(r"[0-9]\Z", before) else ():
        if m := fits(p + "(?![0-9])"):
            try:
                day = date(*(int(m[g]) for g in places))
            except ValueError:
                return m.end(), None, m[0]
            n = (day - date(1900, 1, 1)).days
            x, y = feistel(n // 229, n % 229, 319, 229, key, "date")
            new = date(1900, 1, 1) + timedelta(days=x * 229 + y)
            sign = m[0][4] if places[0] == 1 else "/" if places[1] == 1 else "."
            return m.end(), "date", sign.join(f"{v:0{4 if k == 0 else 2}d}" for k, v in sorted(enumerate((new.year, new.month, new.day)), key=lambda kv: places[kv[0]]))
    if not re.search(r"[0-9-]\Z", before) and (m := fits(r"(?!000|666|9)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![0-9-])")):
        d = digits(m[0])
        area = int(d[:3])
        x, y = feistel(area - (2 if area > 666 else 1), (int(d[3:5]) - 1) * 9999 + int(d[5:]) - 1, 898, 99 * 9999, key, "ssn")
        return m.end(), "ssn", f"{x + (2 if x + 1 >= 666 else 1):03d}-{y // 9999 + 1:02d}-{y % 9999 + 1:04d}"
    edge = not re.search(r"[0-9A-Za-z]\Z", before)
    forms = [r"(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[.-])\d{3}[ .-]\d{4}(?!\d)"] * edge
    forms += [r"\+[1-9]\d{0,2}(?:[ .-]\d{2,5}){2,4}(?!\d)", r"\+[1-9]\d{7,14}(?!\d)"] * (edge and not before.endswith("+"))
    for k, p in enumerate(forms):
        if m := fits(p):
            d = digits(m[0])
            if k == 0 or (len(d) == 11 and d[0] == "1"):
                new = d[:-10] + national(d[-10:], key)
            else:
                code = 1 if d[0] in "17" else 2
                new = d[:code] + number(d[code:], key, "phone")
            return m.end(), "phone", refilled(m[0], new)
    if not re.search(r"[0-9]\Z", before) and (m := fits(r"(?:\d{13,19}|\d{4}(?:-\d{4}){3}|\d{4}(?: \d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)")):
        d = digits(m[0])
        if not luhn(d):
            return m.end(), None, m[0]
        body = number(d[:-1], key, "card")
        return m.end(), "card", refilled(m[0], body + next(c for c in "0123456789" if luhn(body + c)))
    return None


def pseudonymised_model(t, key):
    out, counts, at = [], dict.fromkeys(pii.KINDS, 0), 0
    while at < len(t):
        if got := one(t, at, key):
            end, kind, new = got
            out.append(new)
            if kind:
                counts[kind] += 1
            at += end
        else:
            out.append(t[at])
            at += 1
    return "".join(out), tuple(counts.values())


def test_pii_against_brute_force(spark):
    rng = random.Random(11)
    bits = ["+1 (017) 555-7713", "(200) 333-4444", "555-123-4567", "+1 555 123 4567", "+15551234567", "+44 20 7946 0958", "+442079460958", "4845168114407329", "4845-1681-1440-7329", "3782 822463 10005", "97.51.17.173", "255.0.0.1", "1.2.3.4.5", "a.b+c@mail7.example.com", "x@a.b",
            "1999-02-28", "2024/02/29", "02/28/1999", "28.02.1999", "1999-02-30", "123-45-6789", "666-45-6789", "x", "7", "-", ".", " ", "@", "+", "é", pii.MARK, "and so on, ", "\n"]
    texts = ["".join(rng.choice(bits) + rng.choice(["", " ", " ", ", "]) for _ in range(rng.randrange(1, 14))) for _ in range(400)]
    texts += ["".join(rng.choice("0123456789.-/@+() ab") for _ in range(60)) for _ in range(300)]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    found = 0
    for i, t in enumerate(texts):
        text, counts = pseudonymised_model(t, "key")
        assert (got[i].text, tuple(got[i][f"n_{k}"] for k in pii.KINDS)) == (text, counts), t
        found += sum(counts)
    assert found > 800


def test_pii_of_very_long_texts(spark):
    """Ten million characters that a recursing pattern would not survive."""
    n = 10_000_000
    texts = ["." * n, "7" * n, "@" * n, "x" * n, "x@a" + ".b" * (n // 2), "1-" * (n // 2), "+1 22 " * (n // 6), "a b" * (n // 3) + " 1.2.3.4"]
    got = {r.doc_id: r for r in pii.pseudonymised(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "key").collect()}
    assert [got[i].text == t for i, t in enumerate(texts)] == [True, True, True, True, False, True, True, False] and len(got[4].text) == 43 and got[7].n_ip == 1


def test_pii_shows_no_key(spark, capsys):
    out = pii.pseudonymised(spark.createDataFrame([(1, "x@y.com")], "doc_id long, text string"), "verysecret")
    assert out.first().n_email == 1
    out.explain("extended")
    assert "verysecret" not in capsys.readouterr().out + out._jdf.queryExecution().toString()


def test_head_and_what_is_never_closed(spark):
    pages = ["<head><script>a('</head>')</script><title>Leaked title</title><style>x</style></head><body><p>seen</p>", "<head><title>no end</title><body><p>seen</p>", "<p>seen</p><script>never closed " + "<script>" * 200_000, "<p>seen</p><!-- " + "<!--" * 200_000, "<p>seen</p>" + "<head" * 100_000, "<header><p>seen</p></header><script>'<!--'</script>", "<p>" + "long " * 400_000 + "</p>"]
    df = spark.createDataFrame([(i, f"http://h{i}.com", t) for i, t in enumerate(pages)], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in line_dedup.line_dedup(df).collect()}
    assert [got[i] for i in range(6)] == ["seen"] * 6 and got[6] == ("long " * 400_000).strip()


def test_lines_at_the_ratio_stay(spark):
    rows = [(i, "http://a.com", "x" if i < 3 else f"y{i}") for i in range(30)] + [(100 + i, "http://b.com", "x" if i < 4 else f"y{i}") for i in range(30)]
    got = line_dedup.line_dedup(spark.createDataFrame(rows, "page_id long, url string, t string"), text=F.col("t")).collect()
    assert {r.page_id for r in got if r.n_dropped} == {100, 101, 102, 103}


def test_lines_are_worked_out_once(spark, monkeypatch):
    """The markup is taken out in the job that writes the lines, and in none after it."""
    plans, keep = {}, line_dedup.materialize
    monkeypatch.setattr(line_dedup, "materialize", lambda df, name, *a: plans.update({name: df}) or keep(df, name, *a))
    df = spark.createDataFrame([(i, "http://a.com", f"<p>menu</p><p>own {i}</p>") for i in range(6)], "page_id long, url string, html string").withColumn("none", F.lit(None))
    for bound in (16 << 20, -1):
        monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", bound)
        plans["result"] = out = line_dedup.line_dedup(df, keep=("page_id", "none"))
        assert dict(out.dtypes)["none"] == "void" and {(r.page_id, r.none, r.text) for r in out.collect()} == {(i, None, f"own {i}") for i in range(6)}
        assert [n for n, p in plans.items() if "regexp_replace" in p._jdf.queryExecution().optimizedPlan().toString()] == ["lines"]


def test_white_space_in_lines(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab \t\r\f\x0b\n") for _ in range(rng.randrange(40))) for _ in range(300)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", line_dedup.lines_of(F.col("t")).alias("lines"))
    for r in df.collect():
        assert r.lines == [x for x in (re.sub(r"[ \t\r\f\x0b]+", " ", part).strip(" ") for part in r.t.split("\n")) if x]


def test_rules_removed_and_added_again(spark):
    docs = spark.createDataFrame([(1, "a" * 32 + " token = abcdefgh1"), (2, "a" * 32 + " token = abcdefgh1"), (None, "AKIA" + "B" * 12), (4, None)], "doc_id long, text string")
    assign, access, hex_ = secret_scan.RULES
    scan = lambda rules, book: {(r.doc_id, s["rule"], s["version"], s["start"]) for r in secret_scan.scan_paths(docs, rules=rules, ledger=book).collect() for s in r.found}
    book = secret_scan.updated_ledger(docs, rules=(assign, access))
    assert scan((assign, access), book) == {(1, "assign", "1", 33), (2, "assign", "1", 33), (None, "access", "1", 0)}
    second = secret_scan.Rule("hex", r"[0-9a-f]{32,}", version="2")
    both = {(1, "assign", "1", 33), (2, "assign", "1", 33), (None, "access", "1", 0)}
    for rules, hexes in (((assign, access, hex_), {(1, "hex", "1", 0), (2, "hex", "1", 0)}), ((assign, access, second), {(1, "hex", "2", 0), (2, "hex", "2", 0)}), ((assign, access), set()), ((assign, access, hex_), {(1, "hex", "1", 0), (2, "hex", "1", 0)})):
        book = secret_scan.updated_ledger(docs, rules=rules, ledger=book)
        assert scan(rules, book) == both | hexes and secret_scan.pending_blobs(docs, "text", rules, book).count() == 0
    assert book.count() == 3
