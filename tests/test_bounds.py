"""What once was cut off: deep senses, long lists, large places, weak overlaps, work folders."""

import os

from lemmaforge.operators import diagnose as D
from lemmaforge.operators import render as R
from lemmaforge.operators import nodes as N
from lemmaforge.operators import senses as E
from lemmaforge.operators import structure as S
from lemmaforge.session import work_folder
from lemmaforge.sources import corpus as C
from tests.conftest import rows


def test_senses_of_any_depth_keep_their_numbers(spark):
    data = [(1, 1, [2], "II"), (1, 1, [2, 1], None), (1, 1, [2, 1, 3], None), (1, 1, [2, 1, 3, 1, 4], " "), (1, 1, [2, 2], "b"), (1, 1, [2, 2, 5, 6], ""), (1, 2, [7, 1], None)]
    senses = spark.createDataFrame(data, "rec_id long, part_ord int, path array<int>, number string")
    got = {(r.part_ord, *r.path): r.shown for r in R.numbered_senses(senses).collect()}
    assert got == {(1, 2): "II", (1, 2, 1): "II.1", (1, 2, 1, 3): "II.1.3", (1, 2, 1, 3, 1, 4): "II.1.3.1.4", (1, 2, 2): "b", (1, 2, 2, 5, 6): "b.5.6", (2, 7, 1): "7.1"}


def test_long_lists_and_large_places_have_places_of_their_own(spark):
    items = "; ".join(f"word{i}" for i in range(1500))
    data = [(1, pre, "", "synonyms", items, None, "") for pre in (3, 4, 2_200_001, 2_200_002)]
    senses = spark.createDataFrame(data, "rec_id long, pre int, pos string, role string, definition string, translation string, body string")
    terms = E.route_pseudo_pos(senses)[1]
    assert terms.count() == 6000 and terms.select("ord").distinct().count() == 6000
    assert [r.value for r in terms.orderBy("ord").limit(2).collect()] == ["word0", "word1"]


def test_weak_overlaps_make_families(spark):
    a, b, c = list("abcdef"), list("abghij"), list("klmnop")
    vocab = spark.createDataFrame([("x", sorted(a)), ("y", sorted(b)), ("z", sorted(c))], "dict_id string, vocabulary array<string>")
    assert rows(D.template_families(vocab, 0.2, 6), "dict_id") == [("x",), ("y",)]
    assert rows(D.template_families(vocab, 0.7, 6), "dict_id") == []


def test_only_the_leading_root_is_taken_off(spark):
    files = spark.createDataFrame([("file:/data/dict/data/dict/.x/a.mdx", 1), ("/data/dict/b.mdx", 1), ("/data/dict/.y/c.mdx", 1)], "path string, length long")
    assert rows(C.named_files(files, "/data/dict"), "name") == [("b.mdx",)]


def test_an_application_has_one_work_folder(spark):
    folder = work_folder(spark)
    assert folder == work_folder(spark) and spark.sparkContext.applicationId in folder
    assert os.path.isdir(folder.removeprefix("file:"))


def test_bounds_are_off_unless_set_and_count_what_they_drop(spark):
    blocks = "".join(f'<div class="x">word{i}, {"long" * 20}{i}</div>' for i in range(8))
    nodes = N.html_nodes(spark.createDataFrame([(1, blocks), (2, '<div class="x">a; b</div>')], "rec_id long, content string")).cache()
    hit = N.class_token(["x"])
    assert S.listed_items(nodes, hit).count() == 18 and S.dropped_items(nodes, hit).count() == 0
    bounds = {"max_blocks": 9, "max_length": 60, "max_items": 5}
    assert rows(S.listed_items(nodes, hit, **bounds), "rec_id", "value") == [(1, f"word{i}") for i in range(5)] + [(2, "a"), (2, "b")]
    assert rows(S.dropped_items(nodes, hit, **bounds), "rec_id", "dropped") == [(1, 11)]
    assert rows(S.dropped_items(nodes, hit, max_blocks=6), "rec_id", "dropped") == [(1, 16)]
    long = "x" * 5000
    texts = spark.createDataFrame([(1, long), (2, "short"), (3, "")], "rec_id long, text string")
    assert rows(S.fallback_sections(texts), "rec_id", "body", "dropped") == [(1, long, 0), (2, "short", 0)]
    assert [(r.rec_id, len(r.body) < 4010, r.dropped) for r in S.fallback_sections(texts, limit=4000).orderBy("rec_id").collect()] == [(1, True, 1000), (2, True, 0)]
    marks = spark.createDataFrame([("a", i, i, i * 10000, "arabic") for i in range(1, 302)], "g string, pre int, major long, ordinal long, kind string")
    assert rows(S.plausible_sequences(marks, ["g"]), "markers", "plausible", "bounded") == [(301, True, False)]
    assert rows(S.plausible_sequences(marks, ["g"], max_markers=200), "markers", "plausible", "bounded") == [(301, False, True)]


def test_many_tags_and_classes_count_in_the_score(spark):
    late = "<b>" * 500 + "".join(f"<i{k} class='c{k} twice'>" for k in range(30))
    df = spark.createDataFrame([(late,)], "html string").select(D.record_score("html").alias("whole"), D.record_score("html", 400).alias("cut"))
    row = df.first()
    assert row.whole == 12 + 20 + len(late) // 512 + 1 and row.cut < row.whole
