import random
import re

from tidemark.llm import licenses, queries


def pairs(text):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower())
    return set(zip(words, words[1:], strict=False))


def brute(text):
    best = (0.0, None, None)
    text = text or ""
    units = [("line", u) for u in text.split("\n")] + [("block", u) for u in re.split(r"(?<=\n)\n", text)] + [("text", text)]
    for kind, unit in units:
        for name, template in licenses.TEMPLATES:
            a, b = pairs(unit), pairs(template)
            dice = 2 * len(a & b) / (len(a) + len(b)) if a else 0
            if dice >= licenses.THRESHOLD and dice > best[0]:
                best = (dice, name, kind)
    return best


def test_against_brute_force(make_docs, odd_rows):
    mit = dict(licenses.TEMPLATES[:1])["MIT"]
    texts = ["Released under the MIT License.", "x\nLicensed under CC BY-NC 4.0.\ny", mit, mit.replace("Software", "Work", 3), "intro\n\n" + mit.replace(". ", ".\n") + "\n\nend", mit[: len(mit) // 2], "All rights reserved", "license", "Released under the\nMIT License."]
    rows = odd_rows + [(100 + k, t) for k, t in enumerate(texts)]
    got = {(r["doc_id"], r["dice"], r["license"], r["unit"]) for r in licenses.scan(make_docs(rows)).collect()}
    assert got == {(i, *brute(t)) for i, t in rows}
    assert {r[2] for r in got if r[0] in (100, 101, 102, 103, 104)} == {"MIT", "CC-BY-NC-4.0"}


def test_empty_table(make_docs):
    assert licenses.scan(make_docs([])).collect() == []


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    got = queries.op7_license_dice(spark, sf).collect()
    assert len(got) == len(texts)
    for r in got[:80]:
        assert (r["dice"], r["license"], r["unit"]) == brute(texts[r["doc_id"]])
        if r["license"]:
            assert 0 <= r["first_byte"] < r["end_byte"] <= len(texts[r["doc_id"]].encode())


def brute_run(text):
    words = re.findall(rb"[a-z0-9\x80-\xff]+", text.encode().lower())
    best = (0.0, None)
    for name, template in licenses.TEMPLATES:
        b = pairs(template)
        for i in range(len(words) - 1):
            a = set()
            for pair in zip(words[i:], words[i + 1 :], strict=False):
                a.add(pair)
                if len(a) > 1.3 * len(b):
                    break
                dice = 2 * len(a & b) / (len(a) + len(b))
                if dice >= licenses.THRESHOLD and dice > best[0]:
                    best = (dice, name)
    return best


def test_licences_of_several_blocks_inside_longer_texts(make_docs):
    rng = random.Random(7)
    prose = lambda n: " ".join(rng.choice(["the", "software", "of", "wind", "any", "tide", "is", "sea"]) for _ in range(n))
    mit, bsd = licenses.TEMPLATES[0][1], dict(licenses.TEMPLATES[5:7])["BSD-3-Clause"]
    three = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE", "Software.\n\nTHE")
    texts = {
        "MIT": [f"{prose(300)}\n\n{three}\n\n{prose(300)}", f"{prose(40)}\r\n\r\n" + three.replace("\n", "\r\n") + f"\r\n\r\n{prose(90)}", f"{prose(50)}\n \t\n" + mit.replace(". ", ".\n") + f"\n  \n{prose(200)}", three.replace("sell", "vend") * 3, "This project is released under the MIT License."],
        "BSD-3-Clause": [f"{prose(80)}\n\n" + re.sub(r" (?=[123T]\.? )", "\n\n", bsd).replace("written", "signed") + f"\n{prose(80)}"],
        None: [prose(800), mit[: len(mit) * 2 // 3]],
    }
    rows = [(name, t) for name, each in texts.items() for t in each]
    got = {r["doc_id"]: r for r in licenses.scan(make_docs(list(enumerate(t for _, t in rows)))).collect()}
    for k, (name, text) in enumerate(rows):
        assert (got[k]["dice"], got[k]["license"]) == brute_run(text)
        assert got[k]["license"] == name
        if name:
            part = pairs(text.encode()[got[k]["first_byte"] : got[k]["end_byte"]].decode())
            assert got[k]["dice"] == max(2 * len(part & pairs(t)) / (len(part) + len(pairs(t))) for n, t in licenses.TEMPLATES if n == name)
    assert got[2]["unit"] == "block"
