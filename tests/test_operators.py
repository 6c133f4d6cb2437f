"""Pages, chunks, search, evidence, proposals, ledger, store, engine and stream on small contracts of our own."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from clausemill import cli
from clausemill.config import Settings
from clausemill.engine import Engine
from clausemill.functions.text import tokens
from clausemill.functions.vectors import hashing_encoder
from clausemill.operators import chunks, evidence, ledger, pages, proposals, search
from clausemill.plans.extraction import extracted
from clausemill.sources import files
from clausemill.sources.store import Store
from clausemill.streaming.dropfolder import ingesting

HEAD = "Supply Agreement ref 77\nACME and Bolt"
AGREEMENT = [
    f"{HEAD}\n1. Start. This Agreement commences on March 1, 2024 (the effective date).\nThe parties agree to work together in good faith.",
    f"{HEAD}\n2. Term. The initial term expires on March 31, 2026. This Agreement shall automatically renew for successive periods of twelve (12) months.",
    f"{HEAD}\n3. Notice. Either party may terminate by written notice of non-renewal given at least sixty (60) days before the term ends.\nA breach may be cured within 15 days.",
    f"{HEAD}\n4. Fees. The customer shall pay an annual fee of USD 120,000.00.\n\nThe fee shall increase by 4% each year.",
    f"{HEAD}\n5. Liability. The aggregate liability of a party shall not exceed USD 250,000.00 in all.\n6. Each party shall indemnify, defend and hold harmless the other against claims of third parties.\n7. This Agreement is governed by the laws of the State of Delaware, without regard to conflicts.",
]
LEASE = [
    "A. The lease commences on February 1, 2026 and runs to its end date of January 31, 2031.",
    "B. Tenant shall have the option to renew for one term, exercised by providing written notice not less than ninety (90) days prior to the end.",
    "C. Increase\n☐ The rent shall increase by 2% each year of the term\n☒ The rent shall increase by 3% each year of the term",
]


@pytest.fixture(scope="module")
def texts(spark):
    rows = [("agreement", k, t) for k, t in enumerate(AGREEMENT, 1)] + [("lease", k, t) for k, t in enumerate(LEASE, 1)]
    return spark.createDataFrame(rows, "document_id string, page int, text string")


def test_pages(spark, texts):
    assert {(r.document_id, r.bare) for r in pages.running_lines(texts).collect()} == {("agreement", "Supply Agreement ref 77"), ("agreement", "ACME and Bolt")}
    clean = {(r.document_id, r.page): r.text for r in pages.without_running_lines(texts).collect()}
    assert len(clean) == 8 and clean["lease", 1] == LEASE[0]
    assert clean["agreement", 2] == AGREEMENT[1].removeprefix(HEAD + "\n")
    two = texts.where("page <= 2")
    assert pages.running_lines(two).count() == 0
    docs = spark.createDataFrame([("d", "one\ftwo\f"), ("e", " \f\n")], "document_id string, text string")
    split = pages.pages_of(docs)
    assert [(r.page, r.text) for r in split.where("document_id = 'd'").orderBy("page").collect()] == [(1, "one"), (2, "two"), (3, "")]
    assert [tuple(r) for r in pages.rejected_documents(split).collect()] == [("e", "no_extractable_text")]
    r = spark.range(1).select(pages.lines_of(F.lit("a\r\nb\x0bc\n")).alias("x"), pages.lines_of(F.lit("")).alias("y")).first()
    assert r.x == ["a", "b", "c"] and r.y == []
    # a line in the middle of a page is no running line, however often it stands
    middle = spark.createDataFrame([("m", k, "\n".join([f"{k}{i}" for i in range(4)] + ["same"] + [f"{k}{i}" for i in range(5, 9)])) for k in range(5)], "document_id string, page int, text string")
    assert pages.running_lines(middle).count() == 0
    starts = spark.createDataFrame([("d", 1, 0), ("d", 2, 4)], "document_id string, page int, char_start int")
    assert sorted((r.page, r.start, r.text) for r in pages.sliced(pages.page_spans(starts, docs), docs).collect()) == [(1, 0, "one\f"), (2, 4, "two\f")]


def test_chunks(spark):
    text = ("First clause about rent. " * 20 + "\n\n" + "Second clause; about notice! " * 30 + "\n\n" + "x" * 900).strip()
    got = chunks.page_chunks(text, 300, 60)
    assert all(e - s <= 360 for _, s, e in got) and got[0][1] == 0 and got[-1][2] == len(text)
    spans = [text[s:e] for _, s, e in got]
    assert all(s == s.strip() and s for s in spans) and all(b[1] < a[2] for a, b in zip(got, got[1:], strict=False) if text[b[1]] != "x")
    covered = set()
    for _, s, e in got:
        covered.update(range(s, e))
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)
    df = spark.createDataFrame([("d", 1, text), ("d", 2, " \n"), ("d", 3, "end.")], "document_id string, page int, text string")
    rows = chunks.chunked(df, chunk_size=300, overlap=60).orderBy("chunk_ordinal").collect()
    assert [r.chunk_id for r in rows] == [f"chunk_{i}" for i in range(len(rows))] and rows[-1].page == 3
    with pytest.raises(ValueError):
        chunks.chunked(df, chunk_size=100, overlap=100)


def okapi(corpus, query, k1=1.5, b=0.75, eps=0.25):
    lengths = [len(d) for d in corpus]
    mean = sum(lengths) / len(corpus)
    n = Counter(t for d in corpus for t in set(d))
    idf = {t: math.log(len(corpus) - c + 0.5) - math.log(c + 0.5) for t, c in n.items()}
    floor = eps * sum(idf.values()) / len(idf)
    idf = {t: v if v >= 0 else floor for t, v in idf.items()}
    return [sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in query) for d in corpus]


@pytest.fixture(scope="module")
def cut(texts):
    return chunks.chunked(pages.without_running_lines(texts)).cache()


def test_bm25_equals_plain_python(spark, cut):
    rows = cut.select("document_id", "chunk_id", tokens(F.col("text")).alias("t")).orderBy("document_id", "chunk_ordinal").collect()
    index = search.built(cut.withColumn("ordinal", F.col("chunk_ordinal")))
    words = ["notice", "term", "the", "the", "nowhere"]
    got = {r.key: r.score for r in search.bm25_scores(index, spark.createDataFrame([(1, " ".join(words))], "query_id int, query string")).collect()}
    want = okapi([r.t for r in rows], words)
    for r, w in zip(rows, want, strict=True):
        assert got.get(f"{r.document_id}::{r.chunk_id}", 0.0) == pytest.approx(w, abs=1e-6)


def test_search(spark, cut):
    index = search.built(cut.withColumn("ordinal", F.col("chunk_ordinal")))
    asked = spark.createDataFrame([(1, "termination notice period"), (2, "zebra")], "query_id int, query string")
    hits = search.search(index, asked, top_k=3).collect()
    assert {r.query_id for r in hits} == {1} and any(r.page == 3 and r.document_id == "agreement" for r in hits)
    assert max(r.lexical_score for r in hits) == 1.0
    alone = search.built(cut.where("document_id = 'agreement' and page = 3").withColumn("ordinal", F.lit(0)), corpus=False)
    one = search.search(alone, spark.createDataFrame([(1, "agreement", "written notice")], "query_id int, document_id string, query string")).collect()
    assert len(one) == 1 and one[0].fused_score == round(1 / 61, 6)
    make = hashing_encoder(64)
    both = search.built(cut.withColumn("ordinal", F.col("chunk_ordinal")).withColumn("embedding", make(F.col("text"))))
    got = search.search(both, asked.withColumn("vector", make(F.col("query"))), top_k=2).collect()
    assert {r.query_id for r in got} == {1, 2}
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, key string, rank int")
    b = spark.createDataFrame([(1, "x", 2)], "query_id int, key string, rank int")
    fused = {r.key: r.fused for r in search.fused([a, b]).collect()}
    assert fused == {"x": pytest.approx(1 / 61 + 1 / 62), "y": pytest.approx(1 / 62)}
    with pytest.raises(ValueError):
        search.fused([a, b], weights=[1.0])
    with pytest.raises(ValueError):
        search.search(index, asked, top_k=0)

def _corpus(spark, tmp_path, n=40):
    """Chunks of many words, as a table of files whose size Spark knows."""
    said = lambda i: " ".join(f"w{i * 7919 * k % 5003}" for k in range(1, 400)) + " common rent" * (i % 3) + (" Lease, lease" if i % 5 == 0 else "") + (" only" if i == 7 else "")
    rows = [(i, "chunk_0", i, said(i)) for i in range(n)] + [(n, "chunk_0", n, ""), (n + 1, "chunk_0", n + 1, None)]
    spark.createDataFrame(rows, "document_id long, chunk_id string, ordinal long, text string").write.parquet(f"{tmp_path}/chunks")
    return spark.read.parquet(f"{tmp_path}/chunks")


def test_a_corpus_is_ranked_without_its_postings_written_or_shuffled(spark, tmp_path, monkeypatch):
    corpus = _corpus(spark, tmp_path)
    asked = spark.createDataFrame([(1, "rent lease lease"), (2, "common w5 w10 only"), (3, "nowhere"), (4, "")], "query_id long, query string")
    index = search.built(corpus)
    want = sorted(map(tuple, search.ranked(search.bm25_scores(index, asked), 9).collect()))
    kept, rows = [], search.staged
    monkeypatch.setattr(search, "staged", lambda df, name: kept.append((name, rows(df, name))) or kept[-1][1])
    got = sorted(map(tuple, search.lexical_ranking(search.built(corpus), asked, 9).collect()))
    assert got == want and {r[0] for r in got} == {1, 2}
    terms, postings = index.terms.count(), index.postings.count()
    assert postings > 2 * terms and kept and all(t.count() <= terms + 1 for _, t in kept)
    # what only the overlap finds: of one chunk every term's weight is negative
    one = search.built(corpus.where("document_id = 5"))
    assert [(r.query_id, r.rank, r.score) for r in search.lexical_ranking(one, asked, 9).orderBy("query_id").collect()] == [(1, 1, 2.0), (2, 1, 1.0)]
    # more terms than a task may hold: the join with the postings gives the same
    monkeypatch.setattr(search, "MOST_ASKED", 0)
    assert sorted(map(tuple, search.lexical_ranking(index, asked, 9).collect())) == want


def test_hits_are_joined_with_chunks_that_stay_where_they_are(spark, tmp_path):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "32k")
    try:
        index = search.built(_corpus(spark, tmp_path))
        hits = search.search(index, spark.createDataFrame([(1, "rent lease lease"), (2, "only")], "query_id long, query string"))
        plan = hits._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert [(r.query_id, r.rank, r.document_id, len(r.text) > 1000) for r in hits.where("rank = 1").orderBy("query_id").collect()][1] == (2, 1, 7, True)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_evidence(spark, texts):
    rows = [
        (1, "agreement", "The initial  term EXPIRES on March 31, 2026", 2, None),
        (2, "agreement", "The initial term expires on March 31, 2026", 1, None),
        (3, "agreement", "The initial term expires on March 31, 2026", 9, None),
        (4, "agreement", "The initial term expires on March 31, 2026", None, None),
        (5, "agreement", "This was never agreed by anyone at all", None, None),
        (6, "agreement", "too short", 1, None),
        (7, "agreement", "The initial term expirez on March 31, 2026", 2, None),
        (8, "lease", "The rent shall increase by 2% each year of the term", 3, "2%"),
        (9, "lease", "The rent shall increase by 3% each year of the term", 3, "3%"),
        (10, "lease", LEASE[2].split("\n", 1)[1], 3, "3%"),
        (11, "lease", LEASE[2].split("\n", 1)[1], 3, None),
        (12, "agreement", "The initial term ends when both parties say so", 2, None),
    ]
    quotes = spark.createDataFrame(rows, "ordinal int, document_id string, quote string, page int, value string")
    got = {r.ordinal: r for r in evidence.verified(quotes, texts).collect()}
    assert len(got) == len(rows)
    assert got[1].verified and got[1].method == "normalized_exact_match" and AGREEMENT[1][got[1].start_offset : got[1].end_offset] == got[1].matched_text == "The initial term expires on March 31, 2026"
    assert not got[2].verified and got[2].reason == "wrong_page: quote claimed on page 1 but found on page 2"
    assert got[3].reason == "page_out_of_range: page 9 does not exist"
    assert got[4].verified and got[4].found_page == 2
    assert got[5].reason == "quote_not_found_in_document" and got[6].reason == "quote_too_short: 9 < 12 characters"
    assert got[7].verified and got[7].method == "fuzzy_match" and got[7].similarity > 0.92
    assert not got[8].verified and got[8].reason.startswith("unchecked_option") and got[8].method == "none" and got[8].matched_text
    assert got[9].verified and got[10].verified and not got[11].verified
    assert not got[12].verified and got[12].reason.startswith("quote_not_found_on_page")


def test_containing(spark):
    t = spark.createDataFrame([(1, "an old Straße that  leads to the far end of a green valley there"), (2, "nothing")], "text_id int, text string")
    q = spark.createDataFrame([(1, "ld strasse that leads to the far end of a gr"), (2, "far end"), (3, "leads to the far end of a blue valley")], "quote_id int, quote string")
    assert sorted(map(tuple, evidence.containing(q, t).collect())) == [(1, 1), (2, 1)]


def test_extraction(spark, texts, cut):
    out = extracted(cut, pages.without_running_lines(texts), settings=Settings())
    got = {(r.document_id, r.obligation_type): (r.normalized_value, r.status, r.page) for r in out.obligations.collect()}
    assert {k[1]: v for k, v in got.items() if k[0] == "agreement" and k[1] != "indemnification"} == {
        "contract_start_date": ("2024-03-01", "verified", 1),
        "contract_end_date": ("2026-03-31", "verified", 2),
        "automatic_renewal": ("true", "verified", 2),
        "renewal_duration": ("P12M", "verified", 2),
        "termination_notice_period": ("P60D", "verified", 3),
        "payment_obligation": ("USD 120000.00", "verified", 4),
        "fee_escalation": ("4%", "verified", 4),
        "liability_cap": ("USD 250000.00", "verified", 5),
        "governing_law": ("Delaware", "verified", 5),
        "notice_deadline": ("2026-01-30", "computed", None),
    }
    assert got["lease", "renewal_option_notice"][0] == "P90D" and got["lease", "renewal_option_deadline"][0] == "2030-11-02"
    # the rules quote the first option, which is not ticked: the value fails, and the lease is not approved
    assert got["lease", "fee_escalation"][1] == "failed"
    assert {r.document_id: r.can_approve for r in out.approvals.collect()} == {"agreement": True, "lease": False}
    assert out.failures.count() == 0


def test_bad_proposals(spark, texts, cut):
    def proposer(context, types):
        rows = [
            ("agreement", 1, "term end", "March 31, 2026", "The initial term expires on March 31, 2026.", 2),
            ("agreement", 2, "contract_end_date", "2029-12-31", "another one", 2),
            ("agreement", 3, "notice_deadline", "2026-01-30", "x", 1),
            ("agreement", 4, "colour", "blue", "x", 1),
            ("agreement", 5, "payment", "soon", "The fee shall increase by 4% each year.", 4),
            ("agreement", 6, "start_date", "January 1, 2020", "This Agreement began on January 1, 2020 in full force.", 1),
            ("lease", 0, None, None, "connection refused", None),
        ]
        return spark.createDataFrame(rows, "document_id string, ordinal int, obligation_type string, raw_value string, quote string, page int")

    out = extracted(cut, pages.without_running_lines(texts), proposer=proposer)
    got = {(r.document_id, r.obligation_type): r for r in out.obligations.collect()}
    assert {k: v.status for k, v in got.items()} == {("agreement", "contract_end_date"): "verified", ("agreement", "payment_obligation"): "failed", ("agreement", "contract_start_date"): "failed"}
    assert got["agreement", "payment_obligation"].verification_reason.startswith("value_not_normalizable")
    assert sorted((r.document_id, r.reason) for r in out.failures.collect()) == [
        ("agreement", "missing_verified_inputs"), ("agreement", "model_proposed_computed_field_ignored"), ("agreement", "unknown_obligation_type"), ("lease", "llm_unavailable"),
    ]
    assert not any(r.can_approve for r in out.approvals.collect())


def test_a_models_answers(spark, cut):
    context = cut.where("document_id = 'lease'").withColumn("position", F.col("chunk_ordinal") + 1)
    answer = lambda types, excerpts: 'Sure: ```{"obligations": [{"obligation_type": "law", "raw_value": "Ohio", "quote": "q", "page": 1}]}```'
    assert proposals.proposed_by(context, answer, ["governing_law"]).collect()[0].raw_value == "Ohio"
    bad = proposals.proposed_by(context, lambda types, excerpts: "no", ["governing_law"]).collect()
    assert bad[0].obligation_type is None and bad[0].quote.startswith("model_returned_no_json")
    assert "- a\n" in proposals.prompt(["a"], [(3, "text")]) and "[excerpt 1 | page 3]\ntext" in proposals.prompt(["a"], [(3, "text")])


def test_failure_text(spark):
    rows = spark.createDataFrame([("a", "b"), ("a", None)], "r string, d string").select(ledger.failure_text(F.col("r"), F.col("d")).alias("x")).collect()
    assert [r.x for r in rows] == ["a: b", "a:"]


def test_store(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/s", buckets=3)
    assert store.count() == 0
    put = lambda rows: store.put("doc_pages", spark.createDataFrame(rows, "document_id string, page int, text string"))
    put([(f"d{i}", p, f"{i}.{p}") for i in range(6) for p in (2, 1)])
    put([("d1", 1, "new"), ("d9", 1, "nine")])
    rows = lambda: sorted(map(tuple, store.read("doc_pages").collect()))
    want = sorted([(f"d{i}", p, f"{i}.{p}") for i in range(6) if i != 1 for p in (1, 2)] + [("d1", 1, "new"), ("d9", 1, "nine")])
    assert rows() == want
    assert [r.page for r in store.of_document("doc_pages", "d3").collect()] == [1, 2]
    store.delete(spark.createDataFrame([(f"d{i}",) for i in range(6)], "document_id string"))
    assert rows() == [("d9", 1, "nine")]
    store.delete(spark.createDataFrame([("d9",)], "document_id string"))
    assert rows() == []


def a_pdf(pages, *, packed=True):
    """A small PDF file: a font, and a page for each list of lines."""
    objects = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>"}
    kids, n = [], 4
    for lines in pages:
        said = [line.encode("cp1252").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)") for line in lines]
        body = b"BT /F1 12 Tf 72 720 Td 14 TL " + b" T* ".join(b"(" + x + b") Tj" for x in said) + b" ET"
        body = zlib.compress(body) if packed else body
        objects[n] = b"<< /Length %d %s>>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode " if packed else b"", body)
        objects[n + 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> >> >>" % n
        kids.append(n + 1)
        n += 2
    objects[2] = b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % k for k in kids), len(kids))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (k, objects[k]) for k in sorted(objects)) + b"trailer << /Root 1 0 R /Size %d >>\n%%%%EOF" % n


def test_pdf_pages():
    from clausemill.sources.pdf import Reader, page_texts

    lines = [["The term (12 months) \\ ends; fee \u20ac5", "second line"], [], ["third page"]]
    for packed in (True, False):
        assert page_texts(a_pdf(lines, packed=packed)) == ["\n".join(x) for x in lines]
    with pytest.raises(ValueError, match="encrypted"):
        Reader(a_pdf(lines) + b"\ntrailer << /Encrypt 9 0 R >>\nstartxref")
    # text in hex with a map of its own, gaps as spaces
    mapped = a_pdf([["x"]], packed=False).replace(b"(x) Tj", b"[<0001> -300 <00020002>] TJ")
    mapped = mapped.replace(b"/Encoding /WinAnsiEncoding", b"/Subtype /Type0 /ToUnicode 90 0 R")
    table = b"1 beginbfchar <0001> <0041> endbfchar 1 beginbfrange <0002> <0003> <0062> endbfrange"
    mapped = mapped.replace(b"trailer", b"90 0 obj\n<< /Length %d >>\nstream\n%s\nendstream\nendobj\ntrailer" % (len(table), table))
    assert page_texts(mapped) == ["A bb"]


def test_engine_and_stream(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "agreement.txt").write_text("\f".join(AGREEMENT))
    (source / "empty.txt").write_text("")
    (source / "blank.md").write_text(" \f ")
    (source / "x.docx").write_text("x")
    (source / "broken.txt").write_bytes(b"not \xff\xfe text")
    (source / "lease.pdf").write_bytes(a_pdf([t.replace("\u2610", "[ ]").replace("\u2612", "[x]").split("\n") for t in LEASE]))
    (source / "scan.pdf").write_bytes(a_pdf([[]]))
    (source / "no.pdf").write_text("plain")
    (source / "locked.pdf").write_bytes(a_pdf([["x"]]) + b"\ntrailer << /Encrypt 9 0 R >>\nstartxref")
    engine = Engine(spark, f"file://{tmp_path}/store", Settings(use_fake_llm=True, use_fake_embeddings=True, embedding_dimension=32))
    refused = [
        ("blank.md", "no_extractable_text"), ("broken.txt", "not_valid_utf8"), ("locked.pdf", "unreadable_pdf: the file is encrypted"),
        ("no.pdf", "not_a_pdf"), ("scan.pdf", "no_extractable_text"), ("x.docx", "unsupported_file_type: .docx"),
    ]
    assert sorted(map(tuple, engine.ingest(f"file://{source}").collect())) == refused
    d = {r.filename: r for r in engine.documents().collect()}
    assert set(d) == {"agreement.txt", "lease.pdf"} and d["lease.pdf"].page_count == 3 and d["lease.pdf"].stored_path.endswith("/in/lease.pdf")
    agreement = d["agreement.txt"].document_id
    assert agreement.startswith("contract_") and d["agreement.txt"].page_count == 5 and d["agreement.txt"].chunk_count >= 5
    assert engine.pages(agreement).count() == 5 and engine.status()["retrieval"] == "hybrid_bm25_vector_rrf"
    liability = spark.createDataFrame([(1, "liability")], "query_id int, query string")
    hit = engine.search(liability, top_k=1).first()
    assert (hit.page, hit.char_start, hit.retrieval_mode) == (5, 0, "hybrid_bm25_vector_rrf")
    kept = engine._indexes[True]
    assert engine.search(liability, top_k=1).first() == hit and engine._indexes[True] is kept
    with pytest.raises(ValueError):
        engine.search(spark.createDataFrame([(1, "")], "query_id int, query string"))
    out = engine.extract()
    assert {r.document_id: r.can_approve for r in out.approvals.collect()}[agreement]
    assert {r.document_id: r.can_approve for r in engine.last_extraction().collect()} == {r.document_id: r.can_approve for r in out.approvals.collect()}
    mine = engine.obligations(agreement).collect()
    computed = next(r for r in mine if r.obligation_type == "notice_deadline")
    assert computed.normalized_value == "2026-01-30" and computed.quote is None and computed.computation_inputs.toPython()["operation"] == "subtract"
    quotes = spark.createDataFrame([(agreement, 1, "The initial term expires on March 31, 2026", 2)], "document_id string, ordinal int, quote string, page int")
    assert engine.verify(quotes).first().verified
    with pytest.raises(ValueError):
        engine.verify(quotes.withColumn("page", F.lit(0)))
    c = engine.deadlines(spark.createDataFrame([("renewal_date", "2024-01-31", "P1M"), ("other", "a", "b"), ("renewal_date", "2024-01-31", "P99999Y")], "operation string, anchor string, period string")).collect()
    assert str(c[0].computation.result) == "2024-02-29" and c[1].computation is None and c[2].computation.error.startswith("date_out_of_range")
    lines, code = cli.report_lines(engine)
    assert code == int(not all(r.can_approve for r in out.approvals.collect())) and any(x.startswith("notice_deadline") and "2026-01-30" in x and "(calculated in code)" in x for x in lines)
    assert cli.ingest_lines(engine, f"file://{tmp_path}/nowhere")[1] == 2
    # a document that is taken in again loses its obligations
    engine.put_whole(spark.createDataFrame([(agreement, "new text")], "document_id string, text string"), spark.createDataFrame([(agreement, 1, 0)], "document_id string, page int, char_start int"))
    assert engine.obligations(agreement).count() == 0 and not engine._indexes
    engine.delete(spark.createDataFrame([(agreement,)], "document_id string"))
    assert engine.store.count() == 1
    other = Engine(spark, f"file://{tmp_path}/other", Settings(use_fake_llm=True))
    for _ in range(2):
        ingesting(other, f"file://{source}", f"file://{tmp_path}/progress").awaitTermination(120)
        assert other.store.count() == 2 and other.store.read("doc_pages").count() == 8 and other.store.read("chunks").count() >= 8


def test_a_callers_documents(spark, tmp_path):
    engine = Engine(spark, f"file://{tmp_path}/store", Settings(use_fake_llm=True))
    whole, starts = "", []
    for k, t in enumerate(AGREEMENT, 1):
        starts.append(("7", k, len(whole)))
        whole += t + "\n\n"
    docs = spark.createDataFrame([("7", whole)], "document_id string, text string")
    starts = spark.createDataFrame(starts, "document_id string, page int, char_start int")
    found, verdicts = engine.extract_whole(docs, starts)
    rows = {r.field: r for r in found.collect()}
    assert all(whole[r.char_start : r.char_end] == r.quote and r.contract_id == 7 for r in rows.values() if r.quote)
    assert rows["liability_cap"].value == "USD 250000.00" and rows["notice_deadline"].formula
    assert [(r.contract_id, r.can_approve, r.failures) for r in verdicts.collect()] == [(7, True, [])]
    engine.put_whole(spark.createDataFrame([("not-a-number", "written notice of liability")], "document_id string, text string"), spark.createDataFrame([("not-a-number", 1, 0)], "document_id string, page int, char_start int"))
    got = engine.passages(spark.createDataFrame([(1, "notice of non-renewal")], "query_id int, query string"), k=3).orderBy("rank").collect()
    assert got and all(r.contract_id == 7 and whole[r.char_start : r.char_end] == r.text for r in got)
    one = engine.passages(spark.createDataFrame([(1, "7", "notice")], "query_id int, document_id string, query string"))
    assert {r.contract_id for r in one.collect()} == {7}
    # what fails gives no rows, and says so
    (tmp_path / "file").write_text("not a store")
    broken = Engine(spark, f"file://{tmp_path}/file", Settings(use_fake_llm=True))
    assert broken.passages(spark.createDataFrame([(1, "notice")], "query_id int, query string")).count() == 0
    none, verdicts = broken.extract_whole(docs, starts)
    assert none.count() == 0 and [tuple(r) for r in verdicts.collect()] == [(7, False, ["extraction_crashed"])]


def test_vectors_count_only_if_all_documents_have_them(spark, tmp_path):
    texts = lambda key: (spark.createDataFrame([(key, "written notice of liability")], "document_id string, text string"), spark.createDataFrame([(key, 1, 0)], "document_id string, page int, char_start int"))
    plain = Engine(spark, f"file://{tmp_path}/store", Settings(use_fake_llm=True))
    plain.put_whole(*texts("1"))
    both = Engine(spark, f"file://{tmp_path}/store", Settings(use_fake_llm=True, use_fake_embeddings=True, embedding_dimension=16))
    both.put_whole(*texts("2"))
    asked = spark.createDataFrame([(1, "liability")], "query_id int, query string")
    assert both.status()["retrieval"] == "bm25_only" and {r.vector_score for r in both.search(asked).collect()} == {0.0}
    both.put_whole(*texts("1"))
    assert both.status()["retrieval"] == "hybrid_bm25_vector_rrf" and both.search(asked).first().vector_score > 0


def test_contexts_in_one_pass_equal_searches(spark, cut):
    asked = ["written notice of termination", "fees payable", "the the agreement", "zebra", "rent increase option", "", "liability shall not exceed"]
    rows = [(f"{d}#{k}", d, q) for d in ("agreement", "lease") for k, q in enumerate(asked)]
    queries = spark.createDataFrame(rows, "query_id string, document_id string, query string")
    make = hashing_encoder(32)
    for vectors in (False, True):
        chunks_ = cut.withColumn("ordinal", F.col("chunk_ordinal"))
        if vectors:
            chunks_, queries = chunks_.withColumn("embedding", make(F.col("text"))), queries.withColumn("vector", make(F.col("query")))
        given = [list(r.v) for r in spark.createDataFrame(list(enumerate(asked)), "k int, query string").select("k", make(F.col("query")).alias("v")).orderBy("k").collect()] if vectors else None
        for size in ({"top_k": 1, "pool": 2, "most": 3}, {"top_k": 3, "pool": 25, "most": 14}):
            hits = search.search(search.built(chunks_, corpus=False), queries, top_k=size["top_k"], pool=size["pool"])
            want = search.context(hits, most=size["most"]).select("document_id", "chunk_id", "page", "text", "fused_score", "position")
            got = search.document_contexts(chunks_, asked, vectors=given, **size)
            assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_contexts_make_no_group_call_and_documents_of_one_chunk_equal_searches(spark, monkeypatch):
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    asked = ["written notice", "fees payable"]
    rows = [("a", "c0", 0, 1, "Written notice is due."), ("b", "c0", 0, 1, "Nothing of the kind."), ("c", "c0", 0, 2, "fees fees payable"), ("d", "c0", 0, 1, "")]
    held = spark.createDataFrame(rows, "document_id string, chunk_id string, ordinal int, page int, text string")
    queries = spark.createDataFrame([(f"{d}#{k}", d, q) for d in "abcd" for k, q in enumerate(asked)], "query_id string, document_id string, query string")
    hits = search.search(search.built(held, corpus=False), queries, top_k=5, pool=25)
    want = search.context(hits).select("document_id", "chunk_id", "page", "text", "fused_score", "position").collect()
    got = search.document_contexts(held, asked).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.document_id for r in got} == {"a", "c"}


def test_vectors_in_blocks_equal_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(0)
    x = rng.integers(-2, 3, (90, 4)).astype(float)  # many ties
    rows = [(f"k{i}", i, v.tolist(), "d") for i, v in enumerate(x)] + [("none", 999, None, "d")]
    held = spark.createDataFrame(rows, "key string, ordinal int, embedding array<double>, document_id string")
    asked = spark.createDataFrame([(i, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(9)], "query_id int, vector array<double>")
    plain = asked.crossJoin(held.where("embedding is not null")).select("query_id", "key", "ordinal", F.round(search.cosine(F.col("vector"), F.col("embedding")), search.DIGITS).alias("score"))
    want = sorted(map(tuple, search.ranked(plain, 7, positive=False).collect()))
    for q, c in ((1024, 8192), (2, 11)):
        monkeypatch.setattr(search, "QUERY_BLOCK", q)
        monkeypatch.setattr(search, "CHUNK_BLOCK", c)
        assert sorted(map(tuple, search.vector_ranking(held, asked, 7).collect())) == want


def test_exact_quotes_by_built_in_functions_equal_python(spark):
    pages_ = ["  The  Fee is\tUSD 5 `net` . The fee is USD 5 'net' .", "the fee is usd 5 \x1c'net'", "", " a  b c d e f g h i j", "x" * 30, "caf\u00e9 The fee is USD 5"]
    quotes = ["The fee is USD 5 'net'", "The  Fee is\tUSD 5 `net`", " The fee is USD", "fee is usd 5 ", "a  b c d e f g", "b c d e f g h", "x" * 12, "short", "", "The fee is USD 5", "\tUSD 5 `net` ."]
    rows = [(i, j, q, t, None) for i, q in enumerate(quotes) for j, t in enumerate(pages_)]
    df = spark.createDataFrame(rows, "i int, j int, quote string, page_text string, value string")
    got = {(r.i, r.j): r for r in evidence.on_page(df).collect()}
    native = {(r.i, r.j) for r in evidence._as_it_stands(df, Settings()).where("_at is not null").collect()}
    assert len(got) == len(rows) and {(1, 0), (4, 3), (5, 3), (6, 4)} <= native
    for i, j, q, t, v in rows:
        want = evidence.matched(q, t, v, Settings())
        r = got[i, j]
        assert (r.verified, r.method, r.reason, r.matched_text, r.start_offset, r.end_offset) == want[:6], (q, t)


def test_settings():
    s = Settings.from_environment({"CHUNK_SIZE_CHARS": "500", "USE_FAKE_LLM": "true", "RRF_K": "10"})
    assert (s.chunk_size_chars, s.use_fake_llm, s.rrf_k, s.candidate_pool) == (500, True, 10, 25)
    with pytest.raises(ValueError):
        Settings(chunk_size_chars=100, chunk_overlap_chars=100)
    assert files.TEXT_SUFFIXES == ("txt", "md", "text")


def test_only_what_equals_the_quote_verifies_it_where_an_exact_match_is_asked_for(spark):
    claim = "the tenant keeps the roof in repair"
    texts = spark.createDataFrame([("d", 1, f"So {claim}, always."), ("d", 2, "So the tenant keeps the roof in repaid, always.")], "document_id string, page int, text string")
    quotes = spark.createDataFrame([(1, "d", claim, 2, None), (2, "d", claim, None, None)], "ordinal int, document_id string, quote string, page int, value string")
    got = {r.ordinal: r for r in evidence.verified(quotes, texts, exact=True).collect()}
    assert not got[1].verified and got[1].reason == "wrong_page: quote claimed on page 2 but found on page 1"
    assert got[2].verified and got[2].found_page == 1
    likely = {r.ordinal: r for r in evidence.verified(quotes, texts).collect()}
    assert likely[1].verified and likely[1].method == "fuzzy_match"


def test_proposals_and_obligations_are_computed_once_and_a_page_is_normalised_once(spark):
    seen = spark.sparkContext.accumulator(0)

    def counted(df):
        def run(batches):
            for pdf in batches:
                seen.add(len(pdf))
                yield pdf

        return df.mapInPandas(run, df.schema)

    page = "The initial term expires on March 31, 2026. A fee of USD 5 is due each year."
    texts = spark.createDataFrame([("d", 1, page), ("d", 2, "Nothing more is agreed.")], "document_id string, page int, text string")
    rows = [(1, "d", "The initial term expires on March 31, 2026", 1, None), (2, "d", "Nothing more is agreed", None, None), (3, "d", "A fee of USD 5 is due", 2, None), (4, "d", "A fee of USD 5 is due", 7, None), (5, "d", "This was never agreed by anyone", None, None)]
    quotes = spark.createDataFrame(rows, "ordinal int, document_id string, quote string, page int, value string")
    got = {r.ordinal: r for r in evidence.verified(counted(quotes), texts).collect()}
    assert seen.value == len(got) == len(rows)
    assert got[1].verified and got[2].found_page == 2 and got[3].reason.startswith("wrong_page") and got[4].reason.startswith("page_out_of_range") and got[5].reason == "quote_not_found_in_document"

    seen.value = 0
    kinds = [("a", "contract_end_date", "2030-03-31"), ("a", "termination_notice_period", "P1M"), ("b", "termination_notice_period", "P1M"), ("c", "governing_law", "Ohio")]
    held = spark.createDataFrame([(d, f"{d}:{k}", k, v, "verified") for d, k, v in kinds], "document_id string, id string, obligation_type string, normalized_value string, status string")
    made, lacks = ledger.derived(counted(held))
    assert [(r.document_id, r.normalized_value) for r in made.collect()] == [("a", "2030-02-28")]
    assert sorted((r.document_id, r.obligation_type, r.detail.split(": ")[1]) for r in lacks.collect()) == [("b", "notice_deadline", "contract_end_date"), ("c", "notice_deadline", "contract_end_date, termination_notice_period")]
    assert seen.value == len(kinds)

    evidence._page_form.cache_clear()
    assert all(evidence.matched(q, page, None, Settings())[0] for _, _, q, _, _ in (rows[0], rows[2]))
    assert evidence._page_form.cache_info().misses == 1


def test_a_task_gives_each_querys_best_once_however_many_slices_it_ranks(monkeypatch):
    from types import SimpleNamespace

    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [[f"t{x}" for x in rng.integers(0, 9, rng.integers(0, 6))] for _ in range(90)]
    batches = [pa.RecordBatch.from_pydict({"key": [f"k{i}" for i in part], "ordinal": [i % 4 for i in part], "tokens": [texts[i] for i in part]}) for part in (range(0, 40), range(40, 90))]
    weights = pa.table({"query_id": [q for q in range(12) for _ in range(2)], "term": [f"t{(q + k) % 9}" for q in range(12) for k in range(2)], "weight": [1.0, 2.0] * 12})
    scores = {(q, i): sum(w * (f"t{(q + k) % 9}" in t) for k, w in ((0, 1.0), (1, 2.0))) for q in range(12) for i, t in enumerate(texts)}
    want = {(q, f"k{i}") for q in range(12) for i in sorted((i for i in range(90) if scores[q, i] > 0), key=lambda i: (-scores[q, i], i % 4, f"k{i}"))[:3]}
    monkeypatch.setattr(search, "_SCORES", 60)  # slices of five chunks
    for held in (1 << 20, 100, 20):
        monkeypatch.setattr(search, "_HELD", held)
        out = [r for b in search._best_of_batches(SimpleNamespace(value=(weights, None)), 3)(iter(batches)) for r in b.to_pylist()]
        best = sorted(out, key=lambda r: (r["query_id"], -r["score"], r["ordinal"], r["key"]))
        got = {(r["query_id"], r["key"]) for k, r in enumerate(best) if k < 3 or best[k - 3]["query_id"] != r["query_id"]}
        assert got == want
        assert len(out) == len(want) if held > 36 * 2 else len(out) > len(want)
