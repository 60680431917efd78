import numpy as np

from lodestrata.llm import pii, pii_model, pii_training


def test_gradient():
    p = {k: v.astype(np.float64) for k, v in pii_model.start(3, 4, 5).items()}
    r = np.random.default_rng(0)
    ids, tags = r.integers(0, pii_model.CLASSES, (3, 16)).astype(np.uint8), r.integers(0, pii_model.TAGS, (3, 16))
    _, g = pii_model.loss_and_gradient(p, ids, tags)
    for name, at in (("out", (2, 3)), ("trans", (0, 1)), ("wf", (1, 2)), ("wb", (18, 7)), ("near", (5, 30)), ("bias", (9,)), ("embed", (int(ids[2, 0]), 1))):
        old = p[name][at]
        p[name][at] = old + 1e-5
        up = pii_model.loss_and_gradient(p, ids, tags)[0]
        p[name][at] = old - 1e-5
        down = pii_model.loss_and_gradient(p, ids, tags)[0]
        p[name][at] = old
        assert abs((up - down) / 2e-5 - g[name][at]) < 1e-6 * max(1, abs(g[name][at])), name


def test_viterbi_against_plain_search():
    p = pii.model()
    ids, _ = pii_training.batch(pii_training.Maker(5), 120)
    scores = pii_model.emissions(p, ids)
    found = pii_model.viterbi(p, scores)
    for b in range(120):
        best, back = scores[0, b] + p["first"], []
        for t in range(1, len(scores)):
            path = best[:, None] + p["trans"]
            back.append(path.argmax(0))
            best = path.max(0) + scores[t, b]
        tag = int(best.argmax())
        want = [tag]
        for step in reversed(back):
            want.append(tag := int(step[tag]))
        assert found[:, b].tolist() == want[::-1]


def test_rows_do_not_depend_on_what_they_are_read_with(monkeypatch):
    """A text's scores are the same alone and beside longer ones, as is the end that is read behind it."""
    seen = []

    def viterbi(p, scores, *lengths):
        seen.append(scores.copy())
        return pii_model.viterbi(p, scores, *lengths)

    monkeypatch.setattr(pii, "viterbi", viterbi)
    short, long = "Thanks to Harriet Lindqvist, call +49 30 1234567.", "nothing to see here, " * 40
    alone, beside = pii.tag_texts([short])[0], pii.tag_texts([long, short, long[:300]])[1]
    assert alone == beside
    assert np.allclose(seen[0][: len(short), 0], seen[1][: len(short), 2], atol=1e-4)
    # rows of falling lengths against each row by itself, best tags included
    p, r = pii.model(), np.random.default_rng(1)
    lengths = np.array([64, 63, 41, 40, 40, 9, 4, 1])
    ids = np.zeros((8, 64), np.uint8)
    for row, n in enumerate(lengths):
        ids[row, :n] = r.integers(10, pii_model.CLASSES, n)
    scores = pii_model.emissions(p, ids, None, lengths)
    tags = pii_model.viterbi(p, scores, lengths)
    for row, n in enumerate(lengths.tolist()):
        own = pii_model.emissions(p, ids[row : row + 1, : -(-n // 4) * 4])[:n]
        assert np.allclose(own[:, 0], scores[:n, row], atol=1e-3)
        assert (pii_model.viterbi(p, own)[:, 0] == tags[:n, row]).all() and not tags[n:, row].any()


def test_held_out_accuracy():
    ids, tags = pii_training.batch(pii_training.Maker(123456), 400)
    found = pii_model.viterbi(pii.model(), pii_model.emissions(pii.model(), ids)).T
    inside = tags > 0
    assert (found == tags).mean() > 0.97 and (found == tags)[inside].mean() > 0.93


#: Sentences that no generator made: what stands in [[ ]] is of the kind named.
WRITTEN = """
name|The patch by [[Harriet Lindqvist]] broke the nightly build again.
name|Yesterday [[Marek Doležal]] rotated all certificates on the staging cluster.
name|I had lunch with [[Penelope Ashdown]] and we agreed to drop the old parser.
name|Danke an [[Friedrich Habermann]] für die schnelle Korrektur im Modul.
name|Laut [[Annegret Stolz]] liegt der Fehler im Zwischenspeicher der zweiten Stufe.
name|Le correctif de [[Bastien Charpentier]] a été fusionné ce matin.
name|Según [[Ramiro Echeverría]] la consulta tarda menos con el nuevo plan.
name|Maintainer: [[Sofie van der Velde]]
name|<owner>[[Olivia Brannigan]]</owner>
email|Questions go to [[harriet.lindqvist@fastmail.example]] until Friday.
email|contact = "[[m.dolezal@uni-brno.example]]"
email|Schreib mir an [[fritz_habermann@web.example]], dann schicke ich die Daten.
email|you can reach me under [[p.ashdown (at) mailbox (dot) org]] any time
email|<a href="mailto:[[office@lindqvist-partner.example]]">write</a>
phone|If the pager is silent, dial [[+44 7911 123456]] and ask for the duty engineer.
phone|Unser Büro: Tel. [[+49 221 9988776]], Mo bis Fr.
phone|Appelez-moi au [[06 12 34 56 78]] avant midi.
phone|Mi móvil es [[612 345 678]], llámame luego.
phone|fax: [[(212) 555-0187]]
phone|"mobile": "[[+1-415-555-0132]]"
id_number|The form asks for a social security number such as [[536-22-8761]] in field four.
id_number|Her passport number [[X87456321]] expires in May.
id_number|Meine Steuer-ID lautet [[86 095 742 719]].
id_number|NIF: [[48215639K]]
id_number|numéro de sécurité sociale : [[2 85 07 69 123 456 78]]
address|Please send the replacement disk to [[48 Willow Crescent, Hartlepool]].
address|Wir sind umgezogen: [[Lindenallee 12, 50667 Köln]]
address|Le colis part au [[17 rue des Lilas, 69003 Lyon]].
address|Entregar en [[Calle de Alcalá 45, 28014 Madrid]] por la mañana.
address|mailing address: [[P.O. Box 8812, Fairview]]
""".strip().splitlines()
CLEAN = """
The scheduler restarts every worker after 300 seconds without a heartbeat.
Merge branch 'feature/Login Form' of ssh://git@host.example:7999/core/app.git into main
Release 4.12.0-rc.3 was tagged on 2023-11-07 at 14:05:33 by the build server.
const total = items.reduce((sum, item) => sum + item.price * 1.19, 0);
Die Tabelle hat 48 Spalten und 1200000 Zeilen, davon 17 leer.
Le serveur répond en 250 ms depuis la mise à jour du 12 mars.
La versión 3.2 corrige 14 errores del Panel Principal.
Open the Network Tab and choose Preserve Log before you reload.
ERROR 2024-02-29 10:11:12,345 [pool-3-thread-14] com.acme.Core - queue 0x7ffd12ab full
pip install requests==2.31.0 numpy@1.26 @types/node@20.1.4
The Great Barrier Function in Chapter Seven uses Green Threads.
SHA-256: 9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822cd15d6c15b0f00a08
""".strip().splitlines()


def test_sentences_outside_the_generator():
    found = missed = false = 0
    for line in WRITTEN:
        kind, text = line.split("|", 1)
        a, b = text.index("[["), text.index("]]") - 2
        text = text.replace("[[", "").replace("]]", "")
        spans = pii.checked(text, pii.tag_texts([text])[0])
        hit = any(k == kind and x < b and a < y for x, y, k in spans)
        found, missed = found + hit, missed + (not hit)
        false += sum(not (x < b and a < y) for x, y, _ in spans)
    false += sum(len(pii.checked(text, pii.tag_texts([text])[0])) for text in CLEAN)
    assert found >= 0.9 * (found + missed) and false <= 2, (found, missed, false)


def test_texts(documents):
    filler = "The parser gives up at the first unbalanced bracket and falls back to blocks of 17 lines. " * 40
    rows = [
        (1, filler + "Mail the trace to quelora.ashby@meter.example today. " + filler), (2, "On-call phone: +1-555-120-3344\n"), (3, "ssn: 944-12-9921"), (4, "Anschrift: Kiefernweg 36, 77286 Altbrück\nok"),
        (5, "Please ask Lindilde Iverfield before merging."), (6, "The Tone Parse class is unused. Pinned to shard@7.198.156 for now."), (7, None), (8, ""), (9, " \n"), (1, "nothing"),
    ]
    found = pii.find_personal(documents(rows))
    assert {tuple(r) for r in pii.kinds_found(found).collect()} == {(1, "email"), (2, "phone"), (3, "id_number"), (4, "address"), (5, "name")}
    masked = {r["doc_id"]: r["masked"] for r in found.where("doc_id > 1").collect()}
    assert masked[2] == "On-call phone: [PHONE]\n" and masked[5] == "Please ask [NAME] before merging." and masked[7] is None and masked[8] == ""
    assert pii.find_personal(documents([])).count() == 0


def test_reads_everything():
    """Names of forms no pattern was written for, and none where words only look like one."""
    decomposed = "Lindílde Ivérfield"
    for name in ("Jiří Novák", decomposed, "Lindilde\nIverfield", "Lindilde  Iverfield", "Lindilde Iverfield"):
        text = f"Please ask {name} before merging."
        assert pii.checked(text, pii.tag_texts([text])[0]) == [(11, 11 + len(name), "name")], name
    text = "Please ask (innerFrame, linkedTuner) now"
    assert pii.checked(text, pii.tag_texts([text])[0]) == []
    text = "The parser gives up at the first bracket. " * 200
    assert sum(e - s for s, e in pii.windows(0, len(text))) >= len(text)
