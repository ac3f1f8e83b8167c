"""Rendering of entries, comparison, warnings, votes, navigation, sources."""

import collections
import datetime as dt
import random

from pyspark.sql import functions as F

from lemmaforge.functions import text as T
from lemmaforge.operators import diagnose as D
from lemmaforge.operators import metrics as M
from lemmaforge.operators import render as R
from lemmaforge.plans import validate_queries as V
from lemmaforge.sources import corpus as C
from lemmaforge.streaming import navigation as Nav
from tests.conftest import rows


def entries(spark):
    sense = lambda part, path, number, d, t=None, **k: (
        1, part, path, number, d, t, k.get("labels", []), None, k.get("topic"), [], k.get("syn", []), [], k.get("ex", [])
    )
    return R.Entries(
        spark.createDataFrame([(1, "s", 1, "tarn", "tar·n")], R.RECORDS),
        parts=spark.createDataFrame([(1, 0, "noun", None), (1, 1, "verb", "transitive")], R.PARTS),
        senses=spark.createDataFrame(
            [
                sense(0, [1], "1", "a lake in hills", "山中湖", labels=["northern"], ex=[("by the tarn", "在湖边")]),
                sense(0, [1, 1], None, "its water"),
                sense(0, [2], None, "a pool", topic="Geology"),
                sense(1, [1], None, "to flood", syn=["drown", "swamp"]),
            ],
            R.SENSES,
        ),
        pronunciations=spark.createDataFrame([(1, 0, "uk", "tɑːn", "uk", "a.mp3", None)], R.PRONUNCIATIONS),
        forms=spark.createDataFrame([(1, 0, "plural", ["tarns"])], R.FORMS),
        phrases=spark.createDataFrame([(1, "idiom", 0, "at the tarn", "resting")], R.PHRASES),
        terms=spark.createDataFrame([(1, "crossReference", 0, "mere"), (1, "crossReference", 1, "lough")], R.TERMS),
        sections=spark.createDataFrame([(1, "etymology", 0, None, "Old *word*."), (1, "usageNote", 0, "Region", "Northern.")], R.SECTIONS),
    )


def test_entry_documents(spark):
    made = entries(spark)
    md = R.render_sets(R.render_records(made, "markdown"), "markdown").first()["document"]
    assert md == (
        "# tarn\n\n*headword:* tar·n\n\n- UK /tɑːn/ · 🔊 audio UK\n\n## noun\n\n- **1** *(northern)* a lake in hills — 山中湖\n"
        "  - *by the tarn* — 在湖边\n  - **1.1** its water\n- **2** [Geology] a pool\n\n## verb · transitive\n\n- **1** to flood\n"
        "  - syn: drown, swamp\n\n## Forms\n\n- **plural**: tarns\n\n## Idioms\n\n- **at the tarn** — resting\n\n## See also\n\n"
        "- `mere`\n- `lough`\n\n## Usage · Region\n\nNorthern.\n\n## Origin\n\nOld \\*word\\*.\n"
    )
    text = R.render_sets(R.render_records(made, "text"), "text").first()["document"]
    assert text == (
        "tarn\n\nHeadword: tar·n\n\nPronunciation\nUK /tɑːn/ · audio UK\n\nnoun\n1. (northern) a lake in hills — 山中湖\n"
        "  Example: by the tarn — 在湖边\n  1.1. its water\n2. [Geology] a pool\n\nverb · transitive\n1. to flood\n  Synonyms: drown, swamp\n\n"
        "Forms\nplural: tarns\n\nIdioms\nat the tarn — resting\n\nSee also: mere, lough\n\nUsage · Region\nNorthern.\n\nOrigin\nOld *word*.\n"
    )
    assert rows(R.card_parts(made), "card_ord", "label", "number", "meaning") == [
        (1, "n.", "1", "a lake in hills — 山中湖"), (2, "n.", "1.1", "its water"), (3, "n.", "2", "a pool"), (4, "v.", "1", "to flood"),
    ]
    assert R.record_previews(made).first()["preview"] == "noun · a lake in hills — 山中湖…"
    assert R.code_span(F.lit("a`b")) is not None


def test_comparison_classes(spark):
    cols = "dict_id string, key string, record_hash string, entry_hash string, retention double, duplication double, largest_share double, n_senses int, n_fallback int, failures int, signals array<string>"
    b = lambda key, h="r", e="e", ret=0.9, dup=0.0, share=0.1, s=2, f=0, sig=(): ("d", key, h, e, ret, dup, share, s, f, 0, list(sig))
    before = [b("same"), b("source"), b("lost"), b("fell"), b("gone"), b("grew"), b("none", s=0, f=1), b("honest", dup=0.5), b("other")]
    after = [
        b("same"), b("source", h="q"), b("lost", e="x", s=0, f=1), b("fell", e="x", ret=0.5), b("fresh"), b("grew", e="x", share=0.9),
        b("none", e="x"), b("honest", e="x", s=0, f=1, dup=0.0), b("other", e="x"),
    ]
    got = M.compare_runs(spark.createDataFrame(before, cols), spark.createDataFrame(after, cols))
    assert dict(rows(got, "key", "change")) == {
        "same": "unchanged", "source": "source-changed", "lost": "possible-regression", "fell": "possible-regression", "fresh": "new",
        "gone": "missing", "grew": "possible-regression", "none": "likely-improvement", "honest": "changed", "other": "changed",
    }


def test_mixed_script_tokens(spark):
    df = spark.createDataFrame([(1, "Tarn 山中湖 x2, 水")], "id int, text string")
    assert rows(M.token_bag(df, ["id"], "text"), "token", "n") == [("tarn", 1), ("x2", 1), ("中湖", 1), ("山中", 1), ("水", 1)]


def test_subsense_echo_and_order(spark):
    senses = spark.createDataFrame([(1, 0, [1], "A lake in the hills"), (1, 0, [1, 1], "lake in the hills"), (1, 0, [1, 2], "other")], "rec_id long, part_ord int, path array<int>, definition string")
    assert rows(M.subsense_echoes(senses)) == [(1, 1)]
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "c"]), (["a", "b"], ["b", "a"])], "h array<string>, w array<string>")
    assert [r[0] for r in df.select(M.order_preserved(F.col("h"), F.col("w"))).collect()] == [True, False]


def test_votes(spark):
    scores = spark.createDataFrame(
        [("a", 1, "p", 10), ("a", 2, "p", 10), ("b", 1, "p", 5), ("c", 1, "p", 5), ("c", 2, "p", 5), ("c", 1, "q", 5), ("c", 2, "q", 5)],
        "dict_id string, rec_id long, profile string, score long",
    )
    sizes = spark.createDataFrame([("a", 3), ("b", 3), ("c", 2), ("e", 1)], "dict_id string, n int")
    assert rows(D.profile_vote(scores, sizes)) == [("a", "strong", "p"), ("b", "weak", "generic"), ("c", "conflicting", "generic"), ("e", "absent", "generic")]


def test_step_stack(spark):
    t0 = dt.datetime(2026, 1, 1)
    steps = [
        (0, "tarn", "mere", False), (5, "mere", "lough", False), (9, "lough", "mere", True), (20, "x", "y", False),
        (25, "y", "x", True), (40, "moor", "moor²", False), (40 * 60, "else", "z", False), (40 * 60 + 1, "z", "else", True),
    ]
    df = spark.createDataFrame([(7, t0 + dt.timedelta(seconds=s), i, a, b, k) for i, (s, a, b, k) in enumerate(steps)],
                               "user_id long, ts timestamp, step_id long, from_page string, to_page string, back boolean")
    want = [(0, 2, "tarn"), (1, 3, "mere"), (2, 2, "tarn"), (3, 2, "x"), (4, 1, None), (5, 2, "moor"), (6, 2, "else"), (7, 1, None)]
    assert rows(Nav.stack_batch(df), "step_id", "length", "previous") == want


def test_previous_page_arrival_window(spark):
    t0 = dt.datetime(2026, 1, 1)
    at = lambda s: t0 + dt.timedelta(seconds=s)
    steps = spark.createDataFrame([(1, at(0), 1, "tarn", "mere"), (1, at(10), 2, "mere", "lough")], "user_id long, ts timestamp, step_id long, from_page string, to_page string")
    looks = spark.createDataFrame([(1, at(11), 1, "Lough"), (1, at(12), 2, "other"), (1, at(45), 3, "lough"), (2, at(1), 4, "mere")], "user_id long, ts timestamp, look_id long, page string")
    assert rows(Nav.previous_pages(steps, looks), "look_id", "previous") == [(1, "mere"), (2, None), (3, None), (4, None)]


def test_sources(spark, tmp_path):
    for name in ["a/Words.mdx", "a/Words.mdd", "a/words.10.mdd", "a/Words.2.mdd", "a/Other.mdd", "a/._Words.mdx", ".hid/X.mdx", "a/notes.txt"]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    paired = C.pair_volumes(C.list_files(spark, str(tmp_path))).collect()
    assert [[v.rsplit("/", 1)[1] for v in r.volumes] for r in paired] == [["Words.mdd", "Words.2.mdd", "words.10.mdd"]]
    (tmp_path / "j").mkdir()
    (tmp_path / "j/good.json").write_text('{"dict_id":"d","key":"k","source_ord":1,"content":"c"}\n{broken\n')
    (tmp_path / "j/bad.json").write_text("not json\n")
    good, health = C.read_record_lines(spark, str(tmp_path / "j"))
    assert rows(good, "key") == [("k",)]
    assert rows(health, "good", "bad", "health") == [(0, 1, "unavailable"), (1, 1, "ok")]
    assert C.read_baseline(spark, str(tmp_path / "none")) is None
    (tmp_path / "p.json").write_text('[{"id":"one","selectors":[".a","p b"],"require_title":true,"titles":["(?i)tarn"]}]')
    profile = C.read_profiles(spark, str(tmp_path / "p.json"))[0]
    assert profile["selectors"] == [".a", "p b"] and profile["require_title"]


def test_loudness_gain(spark):
    cases = [(None, -6.0, 100, 0.0), (-26.0, -12.0, 100, 10.0), (-10.0, -0.5, 100, -6.0), (-26.0, -3.0, 100, 2.0), (-16.0, -10.0, 50, -6.0206), (-70.0, -60.0, 100, 20.0), (float("nan"), -20.0, 200, 6.0206)]
    df = spark.createDataFrame(cases, "l double, p double, v int, want double")
    for r in df.select("want", (20 * F.log10(C.loudness_gain("l", "p", F.col("v")))).alias("db")).collect():
        assert abs(r.db - r.want) < 0.01


def test_pronunciation_evidence(spark):
    from lemmaforge.operators import nodes as N

    data = [
        (1, "d", '<p><i>/tɑːn/</i></p><p><a class="uk" href="sound://tarn.mp3">x</a></p>'),
        (2, "d", '<p><a href="sound://none.mp3">x</a></p>'),
        (3, "e", "<p>plain</p>"),
    ]
    nodes = N.html_nodes(spark.createDataFrame(data, "rec_id long, dict_id string, content string"))
    stored = spark.createDataFrame([("d", "tarn.mp3")], "dict_id string, res_key string")
    got = D.pronunciation_evidence(nodes, stored)
    assert rows(got, "dict_id", "ipa_samples", "audio_samples", "audio_resolved", "regions") == [
        ("d", 1, 2, 1, "uk,unmarked"), ("e", 0, 0, 0, ""),
    ]


def test_partitions_grow_with_the_texts(spark):
    """What one task holds while it counts tokens does not grow with the table."""
    docs = spark.range(64).select(F.col("id").alias("rec_id"), F.lit(M.PART_LETTERS // 2).alias("n"))
    placed = M.placed_by_record(docs, letters="n")
    assert placed.rdd.getNumPartitions() == 32 and placed.count() == 64
    few = M.placed_by_record(docs.limit(2), letters="n")
    assert few.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert M.placed_by_record(docs.limit(0), letters="n").count() == 0


def test_baseline_is_worked_out_once(spark, tmp_path):
    """Finding the ranges of the sorted files does not run the plan of the snapshots again."""
    runs = spark.sparkContext.accumulator(0)

    def counted(key):
        runs.add(1)
        return key

    snaps = spark.range(0, 200, 1, 4).select(
        F.lit("d").alias("dict_id"), F.udf(counted, "string")(F.col("id").cast("string")).alias("key")
    )
    C.write_baseline(snaps, str(tmp_path / "base"))
    assert runs.value == 200
    assert C.read_baseline(spark, str(tmp_path / "base")).count() == 200


def test_clauses_of_texts_without_cjk(spark):
    """Such texts are not split; a missing text stays missing."""
    texts = spark.createDataFrame([(0, "plain, words. é"), (1, "中文字国, word; かな。ab"), (2, None), (3, "")], "i int, t string")
    chinese, cjk = T.clause_counts("t")
    assert rows(texts.select("i", chinese.alias("a"), cjk.alias("b")), "i", "a", "b") == [(0, 0, 0), (1, 1, 2), (2, None, None), (3, 0, 0)]


def test_retention_against_plain_counts(spark):
    """Fields in any order, repeated, cut, missing: only tokens between the shared head and tail are laid out."""
    draw = random.Random(3)
    texts = {}
    for i in range(300):
        words = [draw.choice("abcde") for _ in range(draw.randrange(12))]
        cuts = sorted(draw.randrange(len(words) + 1) for _ in range(2))
        pieces = [words[: cuts[0]], words[cuts[0] : cuts[1]], words[cuts[1] :]]
        kept = draw.choice([pieces, pieces[:2], pieces + pieces[:1], pieces[::-1], [pieces[0], ["e"], pieces[2]], []])
        texts[i] = (words, kept)
    data = [(i, " ".join(w), "x " + " ".join(w), [("k", " ".join(p)) for p in kept]) for i, (w, kept) in texts.items()]
    data += [(900, None, None, None), (901, None, "", [("k", "a b")]), (902, "a", "a", [("k", None), ("k", "a")])]
    df = spark.createDataFrame(data, "rec_id int, source_text string, record_text string, fields array<struct<kind string, text string>>")
    wanted = []
    for i, (words, kept) in texts.items():
        source, out = collections.Counter(words), collections.Counter(w for p in kept for w in p)
        wanted.append((i, source.total(), out.total(), (source & out).total(), (out - source).total()))
    wanted += [(900, 0, 0, 0, 0), (901, 0, 2, 0, 2), (902, 1, 1, 1, 0)]
    assert sorted(rows(M.retention(df), "rec_id", "source_tokens", "output_tokens", "covered", "excess")) == wanted


def test_retention_reads_texts_once(spark):
    """No filter over the tokens of a text below the shuffle, and no tokens laid out for a record kept whole."""
    fields = F.array(F.struct(F.lit("k").alias("kind"), F.col("t").alias("text")))
    docs = spark.range(40).select(F.col("id").alias("rec_id"), F.repeat(F.concat(F.col("id"), F.lit(" word ")), F.lit(50)).alias("t"))
    df = M.placed_by_record(docs).select("rec_id", F.col("t").alias("source_text"), F.col("t").alias("record_text"), fields.alias("fields"))
    got = M.retention(df)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "regexp" in line]
    assert {(r.source_tokens, r.covered, r.excess) for r in got.collect()} == {(100, 100, 0)}


def test_lines_keep_rare_white_space(spark):
    """Lines are trimmed as in the SQL: a vertical tab is no white space there."""
    docs = spark.createDataFrame([(1, "\x0bhead\x0b\n \tother, one\f \n \r\n")], "doc_id int, text string")
    assert [(f.kind, f.text) for f in V.with_fields(docs).first().fields] == [("headword", "\x0bhead\x0b"), ("definition", "other, one")]


def test_blanks_and_tokens_of_rare_letters(spark):
    texts = spark.createDataFrame([(0, " a\t b \u3000c  d\u00a0"), (1, "İΣ K2 ႠB"), (2, None), (3, " ")], "i int, t string")
    assert rows(texts.select("i", T.collapse_space("t").alias("c")), "i", "c") == [(0, "a b c d"), (1, "İΣ K2 ႠB"), (2, None), (3, "")]
    assert rows(texts.select("i", T.tokens("t").alias("t")), "i", "t")[1] == (1, ["iσ", "k2", "ⴀb"])
