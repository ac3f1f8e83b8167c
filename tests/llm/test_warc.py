"""Archives as an exact round trip, runs and their merge, and the query against its SQL."""

import base64
import hashlib
import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lemmaforge.llm.warc import LoserTree, archive_pages, url_key


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9).map(lambda x: (x,))), max_size=9))
def test_loser_tree_merges(lists):
    lists = [sorted(x) for x in lists]
    assert [lists[i][j] for i, j in LoserTree(lists)] == sorted(v for x in lists for v in x)
    assert list(LoserTree(lists)) == [(i, j) for _, i, j in sorted((v, i, j) for i, x in enumerate(lists) for j, v in enumerate(x))]


def test_url_keys():
    assert url_key("HTTP://www.A.example.org:8080/P?q=1#x") == "org,example,a)/p?q=1"
    assert (url_key(""), url_key("x.org")) == ("", "org,x)/")


def test_round_trip(spark):
    rng = random.Random(2)
    rows = [(i, f"http://h{i % 7}.org/{i % 3}", rng.choice(["<p>é\r\n\r\nWARC/1.1\r\n", "", f"own {i}\n", "漢" * 40_000])) for i in range(300)]
    rows += [(300, None, None), (None, "http://x y\n.org/", ""), (None, "u", "only without id"), (None, "u", "only without id")]
    rows += [rows[2], rows[299], (301, "http://h1.org/0", "<p>é\r\n\r\nWARC/1.1\r\n")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as run", "2 as payload_digest").repartition(5)
    newest = {}
    for i, _, h in rows:
        if i is not None:
            newest[h or ""] = max(i, newest.get(h or "", i))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        last = newest.get(h or "")
        kind = "response" if last is None or i == last else "revisit"
        want.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, last if kind == "revisit" else None))
    got = archive_pages(df, records=16).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == sorted(want, key=repr)
    keys = [(r.url_key, r.captured_at, r.page_id is not None, r.page_id or 0) for r in sorted(got, key=lambda r: r.position)]
    assert keys == sorted(keys) and len({r.run for r in got}) > 5
    big = [r for r in archive_pages(df, least_bytes=100).collect() if r.record_type == "revisit"]
    assert big and all(r.payload_bytes >= 100 for r in big)
    assert archive_pages(df.limit(0)).count() == 0
