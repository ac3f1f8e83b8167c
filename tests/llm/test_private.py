"""Base spans against Python's patterns, revealing terms on a planted corpus, and replaced texts."""

import random
import re

from lemmaforge.llm.private import private_report, sanitise
from lemmaforge.llm.words import sha256_hex

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(number):
    total = 0
    for i, d in enumerate(reversed(number)):
        x = int(d) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def plain(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            number = re.sub("[^0-9]", "", m[0])
            fine = {
                "email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                "card": 13 <= len(number) <= 19 and luhn(number), "phone": 9 <= len(number) <= 15,
            }[kind]
            if fine:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


HARD = [
    None, "", "a@b.c@d.e", "x@y.z-w_q@r.s", "é a.b+c@d-e.f.g, 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.255", "4111 1111-1111 1111 and 4111 1111 1111 1112",
    "+1 (706) 555-3138, +49 30 1234567890123456 +1 2", "漢字 \U0001f600 me@x.org \U0001f600 9.9.9.9", "1" * 5000, "a" * 200_000, "1-" * 20_000 + "1", "@@a@b.c@",
    "+" * 100 + "1" * 12, " ".join(["me@x.org"] * 700), "1.1.1.1" * 300, "x@y", "a@b.c\n\n1.2.3.4\x00", "٣٣٣٣ 1.2.3.٤", "-4111111111111111-", "+1.2.3.4 5 6 7 8 9",
]


def test_base_spans(spark):
    rng = random.Random(3)
    texts = HARD + ["".join(rng.choices("a1@.+- ()é9", k=rng.randint(1, 80))) for _ in range(400)]
    texts += [" ".join(rng.choices(["4111111111111111", "1.2.3.4", "+44 20 7946 0958", "a@b.co", "word", "12", "-", "."], k=12)) for _ in range(40)]
    rows = [*enumerate(texts), (None, "me@x.org"), (4, HARD[4]), (4, "other 1.2.3.4")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as email", "2 as terms", "3 as _key").repartition(4)
    got = sorted(((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in private_report(df).collect()), key=repr)
    want = []
    for doc, text in rows:
        found = plain(text)
        counts = [sum(f.startswith(k) for f in found) for k in PLAIN]
        want.append((doc, *counts, sha256_hex(",".join(found))))
    assert got == sorted(want, key=repr)
    assert private_report(df.limit(0)).count() == 0


def revealing_corpus():
    rng = random.Random(1)
    filler = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnopqrst"]
    rows = []
    for i in range(300):
        text = rng.choices(filler, k=30)
        if i % 30 == 0:  # the nickname stands by the address in different surroundings, and nowhere else
            text[10:10] = ["Zorro", "writes", "from", "z.orro@x.org"]
        if i % 3 == 0:
            text[20:20] = ["writes", "from"]
        rows.append((i, " ".join(text)))
    copy = " ".join([*rng.choices(filler, k=5), "Copied", "me@copy.org", *rng.choices(filler, k=5)])
    return rows + [(1000 + i, copy) for i in range(20)]


def test_revealing_terms(spark):
    rows = revealing_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: r.spans for r in private_report(df).collect()}
    for doc, text in rows:
        want = plain(text)
        at = text.find("Zorro")
        if at >= 0:
            want.append(f"term:{at}:{at + 5}")
        assert found[doc] == ",".join(want)


def test_sanitised_texts(spark):
    rows = [(i, t, len(t)) for i, t in revealing_corpus()]
    rows += [(2000, "a@b.c and 4111 1111 1111 1111, +44 20 7946 0958 from 1.2.3.4", 1), (2001, None, None), (2002, "clean", 5), (2002, "+1.2.3.4 5 6 7 8 9", 0)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint")
    got = [tuple(r) for r in sanitise(df).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r for r in got if r[0] != 2002}
    assert by[2000][1] == "[EMAIL] and [CARD], [PHONE] from [IP]" and by[2000][2] == len(by[2000][1])
    assert by[2001] == (2001, None, None)
    assert sorted(r[1] for r in got if r[0] == 2002) == ["[PHONE]", "clean"]
    assert all("Zorro" not in (r[1] or "") and "@" not in (r[1] or "") for r in got)
    assert by[1][1] == rows[1][1]


def term_spans(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    found = {r.doc_id: re.findall(r"term:(\d+):(\d+)", r.spans) for r in private_report(df).collect()}
    return {doc: {text[int(a) : int(b)] for a, b in found[doc]} for doc, text in rows}


def test_terms_of_rare_entities_anywhere(spark):
    rows = revealing_corpus()
    far = "".join(f" {text}" for _, text in rows[1:3])  # several hundred characters, without a term of its own
    rows += [(2000, f"Quibble{far} q@x.org"), (2001, f"q@x.org writes{far} again Quibble"), (2002, f"lists{far} a@l.org b@l.org")]
    found = term_spans(spark, rows)
    assert found[2000] == found[2001] == {"Quibble"}
    assert found[0] == {"Zorro"} and found[2002] == set()
    found = term_spans(spark, [*rows[:-2], (2001, rows[-2][1] + " QUIBBLE \u0130x")])
    assert found[2000] == {"Quibble"} and found[2001] == {"Quibble", "QUIBBLE"}


def test_copies_hide_no_term(spark):
    rows = revealing_corpus()
    plain_found = term_spans(spark, rows)
    found = term_spans(spark, rows + [(3000 + i, rows[30][1]) for i in range(400)])
    assert plain_found[30] == {"Zorro"} and all(found[d] == {"Zorro"} for d in (0, 30, 3000, 3399))
    assert {d: f for d, f in found.items() if d < 3000} == plain_found


def planted_corpus(n, seed):
    """Nicknames that stand by their addresses, among rare but innocent words and common filler."""
    rng = random.Random(seed)
    syllables = ["ba", "ke", "li", "mo", "nu", "ra", "si", "to", "ve", "wu", "xa", "zi", "gro", "pla", "ster", "fin"]
    invented = lambda: "".join(rng.choices(syllables, k=4))
    common = ["".join(rng.choices(syllables, k=2)) for _ in range(150)]
    rows, nicknames = [], {}
    for i in range(n):
        # a fifth of the words stands in this text only
        text = [invented() if rng.random() < 0.2 else rng.choice(common) for _ in range(40)]
        if i % 25 == 0:
            person = i // 25 % (n // 100)  # four texts each
            nick = nicknames.setdefault(person, "Nick" + "".join(rng.choices("bcdfgh", k=6)))
            text[5:5] = [nick, "wrote"]
            text[30:30] = ["to", f"p{person}@mail.org"]
        elif i % 25 == 1:
            text[20:20] = ["write", "to", f"once{i}@mail.org"]
        rows.append((i, " ".join(text)))
    return rows, set(nicknames.values())


def test_rare_innocent_words_stay(spark):
    """Planted nicknames are found at two sizes of corpus, and hardly an innocent word is marked."""
    for n in (600, 2400):
        rows, nicknames = planted_corpus(n, n)
        found = term_spans(spark, rows)
        marked = [w for held in found.values() for w in held]
        hits = [w for w in marked if w in nicknames]
        planted = sum(any(w in nicknames for w in text.split()) for _, text in rows)
        assert len(hits) >= 0.95 * planted
        beside = sum(len(set(text.split())) for _, text in rows if "@" in text)
        assert len(marked) - len(hits) <= 0.05 * beside
        assert len(marked) - len(hits) <= 0.1 * len(marked)


def test_the_gardener_keeps_the_words(spark):
    rows, _ = planted_corpus(1500, 9)
    said = "The quixotic gardener planted seventeen rhododendrons near bobs shed and wrote to bob@shed.org about marmalade"
    df = spark.createDataFrame([*rows, (9999, said)], "doc_id bigint, text string").repartition(3)
    assert sanitise(df).where("doc_id = 9999").first().text == said.replace("bob@shed.org", "[EMAIL]")


def test_names_are_generalised_by_their_form(spark):
    """A term that tells much but not nearly all gives way to what kind of word it is."""
    rows = revealing_corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.text for r in sanitise(df, remove=1.01).collect()}
    assert "[NAME] writes from [EMAIL]" in got[0]


def test_columns_may_have_any_names(spark):
    df = spark.createDataFrame([(1, "mail a@b.c now", 14, "x", 2, 3)], "doc_id bigint, text string, n_chars int, email string, _key int, terms int")
    row = sanitise(df).first()
    assert tuple(row) == (1, "mail [EMAIL] now", 16, "x", 2, 3) and sanitise(df).columns == df.columns
