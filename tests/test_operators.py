"""Operators on tiny frames, those without SQL above all."""

import pytest

from parchment.operators import batches as B
from parchment.operators import compare as C
from parchment.operators import jobs as J
from parchment.operators import layout as L
from parchment.operators import outline as O
from parchment.operators import pages as P
from parchment.operators import records as R
from parchment.operators.helpers import asof_last, gap_groups


def df(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def got(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_prefix_binding(spark):
    rows = df(spark, "batch_id string", ("nest-BAX000584-01",), ("nest-BAX0005841",), ("x",))
    roots = df(spark, "root string", ("nest-BAX000584",))
    assert got(B.bind_prefix(rows, roots, exact=False), "batch_id") == [("nest-BAX000584-01",), ("nest-BAX0005841",)]
    assert got(B.bind_prefix(rows, roots), "batch_id") == [("nest-BAX000584-01",)]


def test_id_exists_by_text(spark):
    b = df(spark, "batch_id string", ("nest-BAX000584-01",))
    assert got(B.id_exists(df(spark, "id string", ("bax000584",), ("x000584-0",), ("zz",)), b), "id", "found") == [("bax000584", True), ("x000584-0", True), ("zz", False)]


def test_yield_and_siblings(spark):
    s = df(spark, "root int, ord int, amount string, batch_size string", (1, 1, "0", "200"), (1, 2, "150", None), (2, 1, "x", None), (2, 2, "5", None), (3, 1, "8", None), (3, 2, "2.5", None))
    assert [(r, None if y is None else float(y)) for r, y in got(B.stage_yield(s), "root", "yield_percent")] == [(1, 75.0), (2, None), (3, 31.3)]
    rows = df(spark, "root int, ord int, start_time string, a string, b string", (1, 1, "", "x", " "), (1, 2, "2024", None, "y"))
    assert got(B.coalesce_siblings(rows, "root", ["a", "b"], ["ord"]), "a", "b") == [("x", "y")]


def test_components_and_header(spark):
    c = df(spark, "root int, ord int, display_name string, resolved_name string, component_ref string",
           (1, 1, "Glass Vial", None, "r1"), (1, 2, "Glass vial", None, "r1"), (1, 3, "Stopper", None, "nest-1"), (1, 4, None, "drug substance", "urn:batch:x-1429707"), (1, 5, "other", None, "q"))
    split = B.component_split(c, ["ord"], intermediate="nest-")
    assert got(split, "kind", "name", "lot") == [("packaging", "Glass Vial", ""), ("substance", "drug substance", "1429707")]
    info = df(spark, "root int, batch_size string, batch_size_unit string, dose_strength string, dose_strength_unit string, density string, density_unit string", (1, "5", "x:unit", None, None, "1", "http://qudt.org/vocab/unit/GM"))
    stages = df(spark, "root int, unit_operation string, confident boolean", (1, "op", False))
    flags = B.batch_flags(info, df(spark, "root int", (2,)), split, stages)
    assert got(flags, "rule_no") == [(1,), (4,), (5,)]
    general = B.general_info(df(spark, "root int, a string, b string", (1, " ", "v")), [("A", ["a", "b"]), ("B", ["a"])])
    assert got(general, "ord", "value") == [(0, "v"), (1, "—")]


def test_edits_in_a_chain(spark):
    current = df(spark, "run_id int, section_key string, revision long", (1, "a", 2))
    edits = df(spark, "run_id int, section_key string, ord int, revision long, html string", (1, "a", 1, 2, "x"), (1, "a", 2, 2, "late"), (1, "a", 3, 3, "y"), (1, "b", 1, 0, "new"), (1, "b", 2, 0, "again"))
    ok, bad = R.apply_edits(current, edits)
    assert got(ok, "section_key", "html", "version_num") == [("a", "x", 3), ("a", "y", 4), ("b", "new", 1)]
    assert got(bad, "section_key", "ord", "expected", "actual") == [("a", 2, 2, 3), ("b", 2, 0, 1)]


def test_versions_restore_and_numbers(spark):
    v = df(spark, "run_id int, section_key string, version_num long, html string", (1, "a", 1, "x"), (1, "a", 2, "y"))
    ok, bad = R.restore_versions(v, df(spark, "run_id int, section_key string, version_num long", (1, "a", 1), (1, "a", 9)))
    assert got(ok, "html", "version_num", "label") == [("x", 3, "Restored v1")] and got(bad, "version_num") == [(9,)]
    new = df(spark, "run_id int, section_key string, t int", (1, "a", 5), (1, "a", 4), (2, "b", 1))
    assert got(R.numbered_versions(v, new, ["t"]), "run_id", "t", "version_num") == [(1, 4, 3), (1, 5, 4), (2, 1, 1)]


def test_run_state_rejects(spark):
    e = spark.sql(
        "select * from values (1, 1, 'complete', timestamp'2024-01-01 00:00:00'), (1, 2, 'running', timestamp'2024-01-01 00:00:01'), (1, 3, 'complete', timestamp'2024-01-01 00:00:03'), (1, 4, 'running', timestamp'2024-01-01 00:00:04') t(run_id, event_id, status, at)"
    )
    state, bad = R.run_state(e, ["at", "event_id"])
    r = state.first()
    assert (r.status, r.progress, r.duration_ms) == ("complete", 100, 2000)
    assert got(bad, "status", "before") == [("complete", ""), ("running", "complete")]
    stages = df(spark, "stage string, ord int", ("ingest", 1), ("outline", 2), ("build", 3))
    done = df(spark, "run_id int, stage string, output string, t int", (1, "ingest", "x", 1), (1, "build", "y", 2))
    assert got(R.resume_points(done, stages, ["t"]), "resume_at") == [("outline",)]
    progress = R.stage_progress(df(spark, "run_id int, status string, stage string", (1, "failed", "outline")), stages)
    assert got(progress, "stage", "state") == [("build", "incomplete"), ("ingest", "complete"), ("outline", "invalid")]


def test_block_cascade_and_paths(spark):
    rows = [(1, 0, k, t) for k, t in enumerate(["ab", "Copyrighted material x", "12", "ISO 10943:2023(E)", "a  note", "body", "a  note", "Bibliography", "after"])]
    out = P.block_filter(df(spark, "doc_id int, page_idx int, block_no int, text string", *rows))
    assert [r.drop_reason for r in out.orderBy("block_no").collect()] == ["short", "watermark", "short", "running header", None, None, "repeated footnote", "back matter", "back matter"]
    texts = ["x", "a) one", "1) sub", "ii) deep", "b) two", "ii) no", "plain"]
    items = df(spark, "doc_id int, section string, page_idx int, block_no int, text string", *[(1, "4", 0, k, t) for k, t in enumerate(texts)], (1, "4", 1, 0, "next"))
    assert [r.path for r in P.sub_item_path(items).orderBy("page_idx", "block_no").collect()] == ["", "a", "a.1", "a.1.ii", "b", "b", "b", ""]


def test_sections_and_media(spark):
    rows = df(spark, "doc_id int, ord int, text string, section string, page int", (1, 1, "see Figure 1 and Table 2", "4", 1), (1, 2, "Figure 1 — cap", "4", 1), (1, 3, "tail", "5", 3))
    media = df(spark, "doc_id int, kind string, ref string, page int", (1, "figure", "1", 1), (1, "table", "2", 1), (1, "figure", "7", 2), (1, "figure", "-1", None))
    placed = P.place_media(rows, media)
    assert got(placed, "kind", "ref", "ord", "how") == [("figure", "1", 2, "caption"), ("table", "2", 1, "reference")]
    assert got(P.flush_media(rows, media, placed), "ref", "section", "ord") == [("7", "4", 2.5)]
    inline = df(spark, "doc_id int, section string, page_idx int, block_no int, text string", (1, "4", 0, 0, "intro"), (1, "4", 0, 1, "4.1 Scope"), (1, "4", 0, 2, "body"), (1, "4", 0, 3, "5.1 Other"))
    assert [(r.is_header, r.number) for r in P.inline_subsections(inline).orderBy("block_no").collect()] == [(False, "4"), (True, "4.1"), (False, "4.1"), (False, "4.1")]


def test_outline_passes(spark):
    e = [(1, 0, 1, "1 Scope", 3), (1, 1, 1, "1  scope", 5), (1, 2, 2, "1.1 Old name", 6), (1, 3, 2, "1.1 New name", 7), (1, 4, 1, "Figure 3 x", 8), (1, 5, 1, "2 Far", 9), (1, 6, 1, "Annex A", 90)]
    out = O.dedupe_outline(df(spark, "doc_id int, ord int, level int, title string, page int", *e))
    assert got(out, "title", "page") == [("1 Scope", 5), ("1.1 Old name", 7), ("Annex A", 90)]
    pages = df(spark, "doc_id int, page_idx int, text string", (1, 0, "cover"), (1, 1, "Contents\n1 Scope\n........ 3\n2 Terms ........ 4"), (1, 2, "3 Long\ntitle ......... 6"), (1, 4, "9 Late ........ 9"))
    assert [(r.title, r.printed_page) for r in O.contents_entries(pages).orderBy("page_idx", "line_no").collect()] == [("1 Scope", 3), ("2 Terms", 4), ("3 Long title", 6)]
    ok, bad = O.select_ranges(df(spark, "doc_id int, ord int", (1, 0), (1, 1), (1, 2)), df(spark, "doc_id int, start_idx int, end_idx int", (1, 1, 2), (1, 2, 5)))
    assert got(ok, "ord") == [(1,), (2,)] and got(bad, "end_idx") == [(5,)]
    offsets = O.median_offset(df(spark, "doc_id int, page_idx int, printed_page int", (1, 4, 3), (1, 9, 5), (1, None, 2)))
    assert got(offsets, "offset") == [(5,)]
    entries = df(spark, "doc_id int, ord int, page_idx int, printed_page int", (1, 0, 4, 3), (1, 1, None, 2), (1, 2, None, 90))
    assert [r.page for r in O.monotone_pages(entries, offsets, df(spark, "doc_id int, n_pages int", (1, 20))).orderBy("ord").collect()] == [5, 7, 20]
    a = df(spark, "doc_id int, ord int, level int, title string, page int", (1, 0, 1, "x", 1))
    b = df(spark, "doc_id int, ord int, level int, title string, page int", (1, 0, 1, "y", 1), (2, 0, 1, "z", 1))
    assert got(O.pick_outline([a, b]), "doc_id", "title") == [(1, "y"), (2, "z")]


@pytest.mark.parametrize("few", [0, 256])
def test_short_titles_of_a_document(spark, monkeypatch, few):
    """A short title may begin inside a word; it is looked for in its own document only."""
    monkeypatch.setattr(O, "FEW_TITLES", few)
    titles = df(spark, "doc_id int, ord int, title string", (1, 0, "Scope"), (1, 1, "cope of"), (1, 2, "none"), (2, 0, "Scope"))
    pages = df(spark, "doc_id int, page_idx int, text string", (1, 0, "telescopes\nof"), (1, 1, "Scope\nthe scope of it"), (3, 0, "Scope"))
    assert got(O.title_to_page(titles, pages), "doc_id", "ord", "page_idx") == [(1, 0, 1), (1, 1, 1)]


def test_sample_pages(spark):
    pages = df(spark, "doc_id int, page_idx int", *[(1, k) for k in range(20)], (2, 0))
    assert got(P.sample_pages(pages), "doc_id", "page_idx") == sorted([(1, 1 + 3 * k) for k in range(6)] + [(2, 0)], key=str)


def test_asof_and_gaps(spark):
    items = df(spark, "d int, p int", (1, 0), (1, 5), (2, 1))
    marks = df(spark, "d int, page int, ord int, name string", (1, 2, 0, "a"), (1, 5, 1, "b"), (1, 5, 2, "c"))
    assert got(asof_last(items, marks, ["d"], "p", "page", ["name"]), "p", "name") == [(0, None), (1, None), (5, "c")]
    spans = df(spark, "k int, a double, b double", (1, 0.0, 10.0), (1, 2.0, 4.0), (1, 12.0, 13.0), (1, 40.0, 41.0))
    assert [r.group_no for r in gap_groups(spans, ["k"], "a", "b", 5).orderBy("a").collect()] == [1, 1, 1, 2]


BOX = "doc_id int, page_idx int, id long, x0 double, y0 double, x1 double, y1 double"


CAPTION = "doc_id int, page_idx int, block_no int, text string, y0 double, y1 double"


def test_tables_grow_by_claimed_captions(spark):
    """A claimed caption's top is the table's: what lies above it comes within reach, later tables get what is left."""
    tables = df(spark, BOX, (1, 0, 1, 0.0, 100.0, 9.0, 160.0), (1, 0, 2, 0.0, 110.0, 9.0, 170.0), (1, 0, 3, 0.0, 900.0, 9.0, 950.0), (1, 1, 1, 0.0, 30.0, 9.0, 60.0))
    blocks = df(spark, CAPTION, (1, 0, 0, "Table 1 — near", 80.0, 90.0), (1, 0, 1, "Table 2 — above it", 45.0, 55.0), (1, 0, 2, "Table 3 — too far up", -20.0, -1.0), (1, 0, 3, "Table 4 — inside", 95.0, 104.0), (1, 0, 4, "Table 5 — alone", 870.0, 880.0), (1, 1, 9, "Table 6", 10.0, 20.0))
    # block 0 raises the first table to 80, block 1 to 45; block 3 now lies below its reach and is the second table's
    assert got(L.claim_caption_above(tables, blocks), "page_idx", "id", "block_no", "y0", "n_claimed") == [(0, 1, 0, 45.0, 2), (0, 2, 3, 95.0, 1), (0, 3, 4, 870.0, 1), (1, 1, 9, 10.0, 1)]


def test_captions_by_the_share_of_the_model_box(spark):
    figures = df(spark, BOX, (1, 0, 1, 0.0, 0.0, 100.0, 100.0))
    model = df(spark, "doc_id int, page_idx int, ref string, x0 double, y0 double, x1 double, y1 double", (1, 0, "small", 10.0, 10.0, 20.0, 20.0), (1, 0, "large", 50.0, 0.0, 400.0, 400.0))
    near = df(spark, "doc_id int, page_idx int, id long, ref string")
    assert got(L.figure_caption_by_overlap(figures, model, near), "id", "ref") == [(1, "small")]


def test_figures_end_at_any_higher_number(spark):
    figures = df(spark, "doc_id int, page_idx int, number int, y0 double, y1 double", (1, 0, 1, 300.0, 500.0), (1, 0, 2, 100.0, 200.0), (1, 0, 2, 150.0, 400.0), (1, 1, 1, 0.0, 9.0))
    assert got(L.clip_below_next(figures), "page_idx", "number", "y1") == [(0, 1, 100.0), (0, 2, 200.0), (0, 2, 400.0), (1, 1, 9.0)]


def test_boxes(spark):
    b = df(spark, BOX, (1, 0, 1, 0.0, 0.0, 10.0, 10.0), (1, 0, 2, 35.0, 0.0, 50.0, 10.0), (1, 0, 3, 200.0, 0.0, 210.0, 10.0), (1, 0, 4, 0.0, 0.0, 2.0, 50.0))
    assert got(L.cluster_boxes(b), "id", "cluster") == [(1, 1), (2, 1), (3, 3)]
    t = df(spark, "doc_id int, page_idx int, id int, ref string, x0 double, x1 double, near_figure boolean", (1, 0, 1, "3", 0.0, 10.0, False), (1, 1, 2, None, 1.0, 9.0, False), (1, 2, 3, None, 1.0, 9.0, False), (1, 2, 4, None, 0.0, 5.0, True), (1, 9, 5, None, 0.0, 9.0, False))
    assert got(L.stitch_table_pages(t), "id", "stitched_ref") == [(1, "3"), (2, "3"), (3, "3"), (4, None), (5, None)]
    blocks = df(spark, "doc_id int, page_idx int, block_no int, text string, x0 double, y0 double, x1 double, y1 double", (1, 0, 0, "inside", 1.0, 1.0, 2.0, 2.0), (1, 0, 1, "Figure 2 — c", 1.0, 1.0, 2.0, 2.0), (1, 0, 2, "out", 90.0, 1.0, 92.0, 2.0))
    region = df(spark, "doc_id int, page_idx int, kind string, x0 double, y0 double, x1 double, y1 double", (1, 0, "figure", 0.0, 0.0, 10.0, 10.0))
    assert got(L.suppress_inside(blocks, region), "block_no") == [(1,), (2,)]
    caps = L.claim_caption_above(df(spark, BOX, (1, 0, 1, 0.0, 30.0, 9.0, 60.0)), df(spark, CAPTION, (1, 0, 0, "Table 1 — x", 5.0, 10.0), (1, 0, 1, "Table 2 — y", 26.0, 31.0), (1, 0, 2, "text", 20.0, 29.0)))
    assert got(caps, "id", "text", "y0", "n_claimed") == [(1, "Table 1 — x", 5.0, 1)]
    near = L.caption_near(df(spark, "doc_id int, page_idx int, id int, y0 double, y1 double", (1, 0, 1, 0.5, 0.6)), df(spark, "doc_id int, page_idx int, blocks array<string>", (1, 0, ["Figure 1 - a", "x", "Figure 2 - b", "y"])), "^Figure")
    assert got(near, "caption") == [("Figure 2 - b",)]
    figs = L.negative_ids(df(spark, "doc_id int, page_idx int, id int, ref string", (1, 0, 1, None), (1, 0, 2, "5"), (1, 1, 3, None)))
    assert got(figs, "id", "ref") == [(1, "-1"), (2, "5"), (3, "-2")]
    clip = L.clip_below_next(df(spark, "doc_id int, page_idx int, number int, y0 double, y1 double", (1, 0, 1, 0.0, 100.0), (1, 0, 2, 60.0, 90.0)))
    assert got(clip, "number", "y1") == [(1, 60.0), (2, 90.0)]
    anchor = L.preceding_anchor(df(spark, BOX, (1, 0, 1, 0.0, 50.0, 9.0, 60.0)), df(spark, "doc_id int, page_idx int, text string, y1 double", (1, 0, "a long enough text", 20.0), (1, 0, "short", 40.0), (1, 0, "12", 45.0)))
    assert got(anchor, "anchor") == [("a long enough text",)]


def test_jobs(spark):
    r = J.parse_replies(df(spark, "section string, reply string", ("a", '```json\n{"a": {"x": 1}}\n```'), ("b", 'Sure: [1, 2] ok'), ("c", '{"x": 1'), ("d", None)), {"c": '{"empty":true}'})
    assert got(r, "section", "value", "reason", "truncated") == [("a", '{"x":1}', None, False), ("b", "[1,2]", None, True), ("c", '{"empty":true}', "unparsable", True), ("d", "{}", "unparsable", True)]
    p = J.normalize_phases(df(spark, "k int, value string", (1, '{"equipment": ["a", ""], "software": "s"}'), (2, '["x"]'), (3, '"one"'), (4, "null"), (5, None)))
    assert got(p, "k", "equipment", "software") == [(1, ["a"], ["s"]), (2, ["x"], []), (3, ["one"], []), (4, [], []), (5, [], [])]
    leaves = J.flatten_leaves(df(spark, "run_id int, doc string", (1, '{"a": {"b": ["x", "y"]}, "c": "t"}')), ["a.b", "c", "d"])
    assert got(leaves, "key_path", "value") == [("a.b", "<ul><li>x</li><li>y</li></ul>"), ("c", "t")]
    edited = J.overlay_edits(leaves, df(spark, "run_id int, section_key string, html string, revision int", (1, "a.b", "<ul><li>z</li></ul>", 2), (1, "c", "no", 1)))
    assert got(edited, "key_path", "value", "items") == [("a.b", "<ul><li>z</li></ul>", ["z"]), ("c", "t", None)]
    html = J.sanitize_html(df(spark, "html string", ('<p onclick="x">a<script>b</script><!-- c --><li data-list="bullet" id="q">d &amp; e</li><br/></p>',), (None,)))
    assert got(html, "clean_html") == [('<p>ab<li data-list="bullet">d &amp; e</li><br></p>',), (None,)]
    pairs = J.pair_lists(df(spark, "run_id int, doc string", (1, '{"t": [{"problem": "p", "fix": "f"}, ["a", "b"], ["x"], 3]}')), "$.t", "problem", "fix")
    assert got(pairs, "problem", "fix") == [("a", "b"), ("p", "f")]

    def call(prompt):
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper()

    assert got(J.model_map(df(spark, "prompt string", ("a",), ("bad",)), call, 1), "reply", "error") == [("A", None), (None, "ValueError: no")]
    many = J.model_map(df(spark, "prompt string", *[(p,) for p in ("a", "bad", "c", "d", "e")]).coalesce(1), lambda prompts: [call(p) for p in prompts], 1, batch=3)
    assert got(many, "reply", "error") == [("A", None), ("C", None), ("D", None), ("E", None), (None, "ValueError: no")]
    o = J.review_outcome(df(spark, "reply string", ('{"status": "issues", "issues": ["x"]}',), ("junk",)))
    assert got(o, "status", "message") == [("issues", "1 issue(s)"), ("ok", "no issues")]
    m = J.apply_manual_fields(df(spark, "run_id int, title string, done boolean", (1, "old", False)), df(spark, "run_id int, field string, value string", (1, "t", "new"), (1, "d", "Yes"), (1, "zz", "x")), {"t": "title", "d": "done"}, flags=("done",))
    assert got(m, "title", "done") == [("new", True)]
    page = J.page_results(df(spark, "doc_id int, page_idx int, reply string", (1, 0, '{"text": "a"}'), (1, 1, "failed")))
    assert got(page, "page_idx", "text", "page_w_pts") == [(0, "a", 595.0), (1, "", 595.0)]
    bounds, counts = J.section_bounds(df(spark, "section string, text string", ("a", "One. Two.")), df(spark, "section string, bound string", ("a", "x"), ("b", "y"), ("c", None)))
    assert got(bounds, "section")[0] == ("a",) and got(counts, "origin", "sections") == [("derived", ["a"]), ("kept", ["b"]), ("skipped", ["c"])]
    gold = J.gold_lookup(df(spark, "heading string, label string, text string, ord int", ("Scope of x", "Who?", "t1", 1), ("scope", "why", "t2", 2)), df(spark, "section string, heading string, label string", ("s", "Scope", None), ("w", "scope", "who")))
    assert got(gold, "section", "text") == [("s", "t1\nt2"), ("w", "t1")]


def test_content_hash_ignores_order(spark):
    a = df(spark, "k int, v string", (1, "x"), (1, "y"), (1, "y"))
    b = df(spark, "k int, v string", (1, "y"), (1, "x"), (1, "y"))
    c = df(spark, "k int, v string", (1, "x"), (1, "x"), (1, "y"))
    h = [C.content_hash(d, ["k"]).first()["content_hash"] for d in (a, b, c)]
    assert h[0] == h[1] != h[2]


def test_ordered_similarity(spark):
    cells = "k int, no int, v string"
    a = df(spark, cells, *[(1, i, v) for i, v in enumerate("abcd")], *[(2, i, v) for i, v in enumerate("ab")], (3, 0, "x"))
    b = df(spark, cells, *[(1, i, v) for i, v in enumerate("abcd")], *[(2, i, v) for i, v in enumerate("ba")], (4, 0, "x"))
    assert got(C.ordered_similarity(a, b, "k", "v", ["no"]), "k", "similarity", "equal") == [(1, 1.0, True), (2, 0.5, False), (3, 0.0, False), (4, 1.0, True)]


def test_ids_without_a_known_form_are_found_by_their_text(spark):
    b = df(spark, "batch_id string", ("reg-0a/77",), (None,), ("",))
    assert got(B.id_exists(df(spark, "id string", ("0A/7",), ("g-0a/77",), ("7",), ("7a",)), b), "id", "found") == [("0A/7", True), ("7", True), ("7a", False), ("g-0a/77", True)]


def test_html_pieces(spark):
    rows = [('a < b & c &amp; d > e',), ('<li data-list=x CLASS="a>b">t</LI>',), ("<!-- <p> -->z<?x?><font>q</font>",), ("",), (None,)]
    assert [r.clean_html for r in J.sanitize_html(df(spark, "html string", *rows)).collect()] == ["a &lt; b &amp; c &amp; d &gt; e", '<li data-list="x">t</li>', "zq", "", None]


def test_same_result_under_other_partitioning(spark, sf):
    from parchment.plans import registry

    one, before = {}, spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "8"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            for q in ("batch_matrix_cells", "coalesce_siblings", "outline_dedupe", "run_state"):
                one.setdefault(q, []).append(sorted(map(str, registry.QUERIES[q](spark, sf).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert all(a == b for a, b in one.values())


@pytest.mark.parametrize("few", [0, 256])
def test_titles_are_searched_in_every_source(spark, tmp_path, monkeypatch, few):
    from parchment.plans.texts import title_to_page

    monkeypatch.setattr(O, "FEW_TITLES", few)

    docs = [(1, "hot", "first"), (2, "hot", "A title\nmore of the kind"), (3, None, "with a title inside"), (4, "src1", "A title"), (5, "src2", "ore of the kin")]
    spark.createDataFrame(docs, "doc_id long, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, "A title"), (8, "ore of the kin\nnot this")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {(r.doc_id, r.ord, r.page_idx) for r in title_to_page(spark, str(tmp_path)).collect()}
    assert found == {("hot", 7, 1), (None, 7, 0), ("src1", 7, 0), ("hot", 8, 1), ("src2", 8, 0)}


def test_boxes_meet_once_in_a_grid(spark, monkeypatch):
    import random

    from parchment.operators import helpers

    monkeypatch.setattr(helpers, "CELL_BOXES", 2)
    r = random.Random(2)
    rows = []
    for k in range(160):
        x, y = r.choice([0, 10, 20, 55, 90]) + r.random() * r.choice([0, 5]), r.random() * 100
        rows.append((1, k % 2, k, float(x), float(y), float(x + r.choice([1, 5, 100])), float(y + r.choice([0, 1, 40]))))
    b = df(spark, BOX, *rows)
    want = sorted((p, i, j) for _, p, i, x0, y0, x1, y1 in rows for _, q, j, u0, v0, u1, v1 in rows if p == q and min(x1, u1) > max(x0, u0) and min(y1, v1) > max(y0, v0))
    assert sorted((x.page_idx, x.a_id, x.b_id) for x in helpers.rect_join(b, b, ["doc_id", "page_idx"]).collect()) == want
