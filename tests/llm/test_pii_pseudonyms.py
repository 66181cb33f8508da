import datetime
import hashlib
import random
import re

from pyspark.sql import functions as F

from chronoweave.llm import pii_pseudonyms as P

DOCS = [
    (1, "Call +49 170 1234567 or (415) 555-2671; card 4539 1488 0343 6467 and 4539-1488-0343-6467."),
    (2, "Born 1985-07-14, also 14.07.1985 and 7/14/1985; not 2021-02-30, not 31.02.2020."),
    (3, "IBAN DE89370400440532013000, GB82 WEST 1234 5698 7654 32 and bad DE00370400440532013000"),
    (4, "ssn 123-45-6789 bad 000-12-3456 ip 42.144.35.254 bad 300.1.1.1 mail Jo.Doe42@mail8.example.com"),
    (5, None),
    (6, ""),
    (7, "card 4539148803436467 again, not a card 4539148803436468"),
    (1, "Call +49 170 1234567 or (415) 555-2671; card 4539 1488 0343 6467 and 4539-1488-0343-6467."),
    (None, "1985-07-14"),
    (9, "plain words " * 20_000 + "4539148803436467"),
]


def run(spark, docs, **kw):
    return P.pseudonyms(spark.createDataFrame(docs, "doc_id long, text string").withColumn("found", F.lit(1)), **kw)


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute_feistel(key, high, low, hm, lm):
    for r in range(P.ROUNDS):
        mine, other, mod = (low, high, lm) if r % 2 else (high, low, hm)
        moved = (mine + int(hashlib.sha256(f"{key}:{r}:{mod}:{other}".encode()).hexdigest()[:15], 16)) % mod
        high, low = (high, moved) if r % 2 else (moved, low)
    return high, low


def test_formats_and_links(spark):
    rows = {r["doc_id"]: r for r in run(spark, DOCS).collect()}
    one = rows[1]["text"]
    assert re.fullmatch(r"Call \+4\d \d{3} \d{7} or \(4\d\d\) 5\d\d-\d{4}; card (\d{4} ){3}\d{4} and (\d{4}-){3}\d{4}\.", one) and "1234567" not in one
    cards = re.findall(r"\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{4}", one)
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and luhn(re.sub(r"\D", "", cards[0]))
    assert re.sub(r"\D", "", cards[0]) in rows[7]["text"] and "4539148803436468" in rows[7]["text"]
    assert rows[9]["text"].endswith(re.sub(r"\D", "", cards[0]))
    iso, dotted, slashed = re.match(r"Born (\S+), also (\S+) and (\S+); not 2021-02-30, not 31.02.2020", rows[2]["text"]).groups()
    y, m, d = map(int, iso.split("-"))
    assert list(map(int, dotted.split("."))) == [d, m, y] and list(map(int, slashed.split("/"))) == [m, d, y] and iso != "1985-07-14"
    assert rows[None]["text"] == iso
    assert "DE00370400440532013000" in rows[3]["text"] and "DE89370400440532013000" not in rows[3]["text"] and " WEST " in rows[3]["text"]
    for iban in (re.search(r"DE\d{20}", rows[3]["text"])[0], re.search(r"GB\d\d WEST[ \d]{18}", rows[3]["text"])[0].replace(" ", "")):
        assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert "000-12-3456" in rows[4]["text"] and "300.1.1.1" in rows[4]["text"] and "123-45-6789" not in rows[4]["text"] and "42.144.35.254" not in rows[4]["text"]
    assert re.search(r"mail \w\w\.\w{5}@mail8\.example\.com", rows[4]["text"]) and "Jo.Doe42" not in rows[4]["text"]
    assert rows[5]["text"] is None and rows[6]["text"] == "" and rows[5]["n_found"] == 0
    assert (rows[2]["n_found"], rows[2]["n_changed"], rows[2]["n_iso_date"], rows[3]["n_iban"], rows[1]["n_card"]) == (5, 3, 1, 2, 2)


def test_equals_brute_force(spark):
    text = {r["doc_id"]: r["text"] for r in run(spark, DOCS).collect()}
    high, low = brute_feistel(P._keyed(P.EXAMPLE_KEY, "card"), 4539148, 80343646, 10**7, 10**8)
    payload = f"{high:07d}{low:08d}"
    assert f"card {payload}{next(c for c in range(10) if luhn(payload + str(c)))} again" in text[7]
    high, low = brute_feistel(P._keyed(P.EXAMPLE_KEY, "ip"), 42 * 256 + 144, 35 * 256 + 254, 65536, 65536)
    assert f"ip {high // 256}.{high % 256}.{low // 256}.{low % 256} bad" in text[4]


def test_undo_gives_the_texts_back(spark):
    back = P.pseudonyms(run(spark, DOCS).drop("n_found"), undo=True).collect()
    assert sorted((str(r["doc_id"]), str(r["text"]).lower()) for r in back) == sorted((str(i), str(t).lower()) for i, t in DOCS)


def test_other_key_and_empty_table(spark):
    a, b = (run(spark, DOCS[:1], key=k).first()["text"] for k in ("a", "b"))
    assert a != b
    assert run(spark, []).count() == 0


class Brute:
    """Every kind worked out in plain Python."""

    def __init__(self, key):
        self.key = key

    def pair(self, kind, high, low, hm, lm):
        return brute_feistel(P._keyed(self.key, kind), high, low, hm, lm)

    def digits(self, kind, s):
        u = len(s) // 2
        a, b = self.pair(kind, int(s[:u]), int(s[u:]), 10**u, 10 ** (len(s) - u))
        return f"{a:0{u}d}{b:0{len(s) - u}d}"

    def into(self, shape, signs, what):
        it = iter(signs)
        return "".join((next(it).upper() if c.isupper() else next(it)) if re.match(f"[{what}]", c) else c for c in shape)

    def letters(self, s):
        out, key = [], P._keyed(self.key, "email")
        base = lambda n, w: "".join("0123456789abcdefghijklmnopqrstuvwxyz"[n // 36**i % 36] for i in reversed(range(w)))
        for at in range(0, len(s), 24):
            part = s[at : at + 24]
            u, n = len(part) // 2, len(part)
            if n == 1:
                out.append(base((int(part, 36) + int(hashlib.sha256(f"{key}:99".encode()).hexdigest()[:15], 16) % 36) % 36, 1))
            else:
                a, b = brute_feistel(key, int(part[:u], 36), int(part[u:], 36), 36**u, 36 ** (n - u))
                out.append(base(a, u) + base(b, n - u))
        return "".join(out)

    def email(self, m):
        name, _, host = m.partition("@")
        signs = re.sub("[^A-Za-z0-9]", "", name).lower()
        return self.into(name, self.letters(signs), "A-Za-z0-9") + "@" + host if signs else m

    def iban(self, m):
        plain = m.replace(" ", "")
        country, check, bank = plain[:2], plain[2:4], plain[4:]
        rest = lambda b, c: int("".join(str(int(x, 36)) for x in b + country + c)) % 97
        digits = re.sub("[^0-9]", "", bank)
        if rest(bank, check) != 1 or len(digits) < 2 or not "02" <= check <= "98":
            return m
        new = self.into(bank, self.digits("iban", digits), "0-9")
        return self.into(m, f"{country}{98 - rest(new, '00'):02d}{new}", "A-Z0-9")

    def ssn(self, m):
        a, g, s = map(int, m.split("-"))
        if not (0 < a < 900 and a != 666 and g and s):
            return m
        high, low = self.pair("ssn", a - 1 - (a > 666), (g - 1) * 9999 + s - 1, 898, 99 * 9999)
        high += 1 + (high + 1 >= 666)
        return f"{high:03d}-{low // 9999 + 1:02d}-{low % 9999 + 1:04d}"

    def ip(self, m):
        o = list(map(int, m.split(".")))
        if max(o) > 255 or re.search(r"(^|[.])0[0-9]", m):
            return m
        a, b = self.pair("ip", o[0] * 256 + o[1], o[2] * 256 + o[3], 65536, 65536)
        return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"

    def card(self, m):
        d = re.sub("[^0-9]", "", m)
        if not luhn(d):
            return m
        payload = self.digits("card", d[:-1])
        return self.into(m, payload + next(str(c) for c in range(10) if luhn(payload + str(c))), "0-9")

    def phone(self, m):
        d = re.sub("[^0-9]", "", m)
        if m[0] == "+":
            return self.into(m, d[0] + self.digits("phone", d[1:]), "0-9")
        p = self.digits("phone", d[1:3] + d[4:10])
        return self.into(m, d[0] + p[:2] + d[3] + p[2:], "0-9")

    def date(self, m, order, sign):
        part = m.split(sign)
        field = {f: int(part[order.index(f)]) for f in "ymd"}
        try:
            day = datetime.date(field["y"], field["m"], field["d"])
        except ValueError:
            return m
        n = (day - datetime.date(1800, 1, 1)).days
        if not 0 <= n < 146097:
            return m
        a, b = self.pair("date", n // 773, n % 773, 189, 773)
        to = datetime.date(1800, 1, 1) + datetime.timedelta(a * 773 + b)
        short = min(len(part[0]), len(part[1])) == 1
        text = {"y": f"{to.year:04d}", "m": f"{to.month}" if short else f"{to.month:02d}", "d": f"{to.day}" if short else f"{to.day:02d}"}
        return sign.join(text[f] for f in order)


def test_every_kind_equals_brute_force(spark):
    rng, brute = random.Random(3), Brute("k1")
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    values = {k: [] for k, _ in P.KINDS}
    for _ in range(25):
        values["email"].append("".join(rng.choice("abcXYZ019._-+") for _ in range(rng.choice([1, 2, 5, 24, 25, 40]))) + rng.choice(["@mail.example.org", "@x.de"]))
        bank = digits(18) if rng.random() < 0.6 else "WEST" + digits(14)
        check = 98 - int("".join(str(int(x, 36)) for x in bank + "DE00")) % 97
        whole = f"DE{check if rng.random() < 0.8 else 97:02d}{bank}"
        values["iban"].append(whole if rng.random() < 0.5 else " ".join(whole[i : i + 4] for i in range(0, len(whole), 4)))
        values["ssn"].append(f"{rng.choice([0, 1, 665, 666, 667, 899, 900, rng.randrange(1000)]):03d}-{rng.randrange(100):02d}-{rng.randrange(10000):04d}")
        values["ip"].append(".".join(str(rng.choice([0, 1, 255, 256, rng.randrange(300)])) for _ in range(4)))
        body = digits(rng.choice([12, 14, 15, 18]))
        own = body + next(str(c) for c in range(10) if luhn(body + str(c))) if rng.random() < 0.8 else body + "0"
        values["card"].append(own if len(own) != 16 or rng.random() < 0.5 else "-".join(own[i : i + 4] for i in range(0, 16, 4)))
        values["phone"].append(rng.choice([f"+{rng.randint(1, 9)}{digits(10)}", f"+49 {rng.randint(100, 999)} {digits(7)}", f"({rng.randint(200, 999)}) {rng.randint(200, 999)}-{digits(4)}", f"{rng.randint(200, 999)}.{rng.randint(200, 999)}.{digits(4)}"]))
        y, m, d = rng.choice([1799, 1800, 2199, 2200, rng.randint(1900, 2030)]), rng.randint(1, 13), rng.randint(1, 31)
        values["iso_date"].append(f"{y:04d}-{m:02d}-{d:02d}")
        values["day_date"].append(rng.choice([f"{d}.{m}.{y}", f"{d:02d}.{m:02d}.{y}"]))
        values["month_date"].append(rng.choice([f"{m}/{d}/{y}", f"{m:02d}/{d:02d}/{y}"]))
    work = {k: getattr(brute, k) for k in ("email", "iban", "ssn", "ip", "card", "phone")} | {"iso_date": lambda m: brute.date(m, "ymd", "-"), "day_date": lambda m: brute.date(m, "dmy", "."), "month_date": lambda m: brute.date(m, "mdy", "/")}
    first = [re.compile(f"^(?:{p})$") for _, p in P.KINDS]
    rows, want = [], []
    for kind, own in values.items():
        for v in own:
            at = next((i for i, p in enumerate(first) if p.match(v)), None)  # what a value is taken for
            named = P.KINDS[at][0] if at is not None else None
            rows.append((len(rows), f"<{v}>"))
            want.append(f"<{work[named](v) if named else v}>")
    got = {r["doc_id"]: r["text"] for r in P.pseudonyms(spark.createDataFrame(rows, "doc_id long, text string"), key="k1").collect()}
    assert [got[i] for i in range(len(rows))] == want
    assert sum(f"<{v}>" != w for (_, v), w in zip([(i, t[1:-1]) for i, t in rows], want, strict=True)) > 120


def test_callers_columns_survive(spark):
    docs = spark.createDataFrame([(1, "ip 42.144.35.254", "a", "b")], "doc_id long, text string, __found string, __FOUND_ string")
    row = P.pseudonyms(docs).first()
    assert (row["__found"], row["__FOUND_"], row["n_ip"]) == ("a", "b", 1)
