import numpy as np
from pyspark.sql import functions as F

from lexisift.llm import pii
from lexisift.llm.bilstm_crf import Tagger, encode, train
from lexisift.llm.pii_rules import email_ok, name_ok

POSITIVE = [
    ("Check whether SSN 117-86-3521 is already in the file.", {"id_number"}),
    ("Contact: wendfield-o at mail dot example dot com", {"email"}),
    ("Rückruf bitte an +49 30 23125 847.", {"phone"}),
    ("Le colis part pour le 143 bis bd de la Filature, Montclair-sur-Orbe.", {"address"}),
    ("Redacta una respuesta para lucía quintdero.", {"name"}),
    ("Mein Name ist Herr Grünmüller und ich brauche die Rechnung, mailto:ursula_steinhofer@postbox.example", {"name", "email"}),
    ("The parcel goes to Flat 7, 205 Juniper Lane, Marrowdale WX8 4QT.", {"address"}),
    ("Gérard Beaugnon", {"name"}),
]
NEGATIVE = [
    "Build 482-19-3939 failed on the second runner.",
    "Jenkins and Victoria Metrics were restarted 24 times.",
    "See section 12 Baker notation, page 43.",
    "Install @acme/ui-kit@19.4.1 before running it.",
    "Upgrade the client from 10.2.115.301 to 11.0.0 first.",
    "Port 8051 on Maple Street cluster is closed.",
    "",
    "   ",
]


def test_kinds():
    found = pii.find_spans([t for t, _ in POSITIVE] + NEGATIVE + [None])
    for (text, kinds), spans in zip(POSITIVE, found):
        assert {k for _, _, k in spans} == kinds, text
    assert found[len(POSITIVE) :] == [[]] * (len(NEGATIVE) + 1)


def test_a_long_text_is_decoded_whole():
    filler = "The scanner compared the whole conversation. "
    text = filler * 400 + "Check whether SSN 117-86-3521 is already in the file. " + filler * 300
    (spans,) = pii.find_spans([text])
    assert [(text[a:b], k) for a, b, k in spans] == [("SSN 117-86-3521", "id_number")]


def test_redaction_keeps_the_rest(spark):
    rows = [(1, POSITIVE[0][0]), (2, None), (3, ""), (4, "Tel. 911 555 658; Firmado: Emilio Valares"), (5, "nothing")]
    df = pii.redact(pii.tag(spark.createDataFrame(rows, "i int, t string"), "t"), "t")
    got = {r["i"]: r["redacted"] for r in df.collect()}
    assert got == {1: "Check whether <ID_NUMBER> is already in the file.", 2: None, 3: "", 4: "Tel. <PHONE>; Firmado: <NAME>", 5: "nothing"}


def test_fields_and_cut_snippets(spark):
    cut = "x" * 185 + " a.b@mail.examp"
    req = spark.createDataFrame([("r1", POSITIVE[4][0]), ("r1", POSITIVE[4][0]), ("r2", None), (None, "a@b.com")], "request_id string, content string")
    ev = spark.createDataFrame([(7, cut, [(0, 1, "a@bcd.com"), (0, 1, None)]), (8, None, None), (9, "a@bcd.com", [])], "delivery_id long, content_snippet string, matched_spans array<struct<start_pos:int,end_pos:int,matched:string>>")
    assert len(cut) == pii.SNIPPET
    assert {tuple(r) for r in pii.found(req, ev).collect()} == {("content", "r1", "name"), ("matched", "7", "email"), ("content_snippet", "9", "email")}


def test_viterbi_is_exact():
    """Against all transitions, those that the tags rule out at no price; behind a text stands tag 0."""
    t = pii._tagger(pii.MODEL)
    r = np.random.default_rng(1)
    scores = r.normal(size=(25, t.tags, 30)).astype("f4") * 4
    lengths = r.integers(1, 26, 30)
    lengths[-1] = 25
    got = t.decode(scores, lengths)
    trans = t.w["T"].astype(float)
    for i in range(t.tags):
        for j in range(1, t.tags):
            if i != 0 if j % 2 else i not in (j, j - 1):
                trans[i, j] = -1e6
    trans[1::2, 0] = -1e6
    for j, n in enumerate(lengths):
        best = scores[0, :, j].astype(float)
        for k in range(1, n):
            best = (best[:, None] + trans).max(0) + scores[k, :, j]
        y = got[j, :n]
        value = scores[np.arange(n), y, j].sum() + trans[y[:-1], y[1:]].sum() + trans[y[-1], 0]
        assert abs(value - (best + trans[:, 0]).max()) < 1e-2 and not got[j, n:].any()


def test_training_learns():
    def windows(rng, batch):
        ids = np.stack([encode("".join(rng.choice(["aaa", "bbb"], 4))) for _ in range(batch)]).astype(int)
        return ids, (ids == encode("b")[0]).astype(np.int64) * (1 + (np.roll(ids, 1, 1) == ids) * (np.arange(12) > 0))

    t = train(windows, 4, 3, 400, 32, 1)
    ids, gold = windows(np.random.default_rng(9), 50)
    path = t.decode(t.emissions(np.ascontiguousarray(ids.T)), np.full(50, 12))
    assert (path == gold).mean() > 0.98 and isinstance(t, Tagger)


def test_checks():
    assert email_ok("a.b (at) c (dot) org") and not email_ok("logo@2x.png") and name_ok("Dr. Weiss") and not name_ok("Maple Street") and not name_ok("Hans")


def test_extra_columns(spark):
    df = spark.createDataFrame([(1, "Tel. 911 555 658", 5)], "i int, t string, pii int").drop("pii")
    assert pii.tag(df, "t").select(F.size("pii")).first()[0] == 1
