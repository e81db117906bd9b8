import datetime
import re

import pytest
from pyspark.sql import functions as F

from lakejoin.llm import pii


def run(spark, texts, key="k1"):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for r in sorted(pii.pseudonymize(df, key).collect(), key=lambda r: r["doc_id"])]


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def test_formats_stay_and_values_link(spark):
    t = "card 4111111111111111 phone +1 (415) 555-0132 ssn 123-45-6789 ip 10.0.0.7 on 2021-03-04, 04.03.2021, 03/04/2021 by ann.b@mail7.example.com."
    a, b = run(spark, [t, "again 4111111111111111 and 10.0.0.7 and ann.b@mail7.example.com"])
    kinds = [x["kind"] for x in a["pii"]]
    assert kinds == ["card", "phone", "ssn", "ip", "date", "date", "date", "email"]
    v = [x["value"] for x in a["pii"]]
    assert re.fullmatch(r"\d{16}", v[0]) and luhn(v[0]) and v[0] != "4111111111111111"
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", v[1])
    assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", v[2]) and v[2][:3] not in ("000", "666") and v[2][0] != "9"
    assert re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", v[3]) and all(int(o) < 256 for o in v[3].split("."))
    days = {datetime.date.fromisoformat(v[4]), datetime.datetime.strptime(v[5], "%d.%m.%Y").date(), datetime.datetime.strptime(v[6], "%m/%d/%Y").date()}
    assert len(days) == 1 and 1900 <= days.pop().year < 2100
    assert v[7].endswith("@mail7.example.com")
    for x in ("4111111111111111", "555-0132", "123-45-6789", "10.0.0.7", "2021-03-04", "ann.b"):
        assert x not in a["text"]
    assert re.sub(r"\S+@", "@", re.sub(r"\d", "9", a["text"])).startswith("card 9999999999999999 phone +9 (999) 999-9999 ssn 999-99-9999 ip ")
    assert [x["value"] for x in b["pii"]] == [v[0], v[3], v[7]]
    assert run(spark, [t], "k2")[0]["text"] != a["text"]


def test_what_does_not_validate_stays(spark):
    t = "4111111111111112 and 000-12-3456, 300.1.1.1, 2021-02-30, 31.02.2021, x4111111111111111, 1234"
    r = run(spark, [t])[0]
    assert r["text"] == t and r["pii"] == []


def test_forms_of_cards_and_phones_link(spark):
    shape = lambda t: re.sub("[0-9]", "9", t)
    cards = ["4111111111111111", "4111 1111 1111 1111", "4111-1111-1111-1111"]
    phones = ["+1 (415) 555-0132", "415-555-0132", "(415) 555-0132", "415.555.0132", "1-415-555-0132", "+1 415 555 0132", "+14155550132"]
    others = ["+44 20 7946 0958", "+442079460958", "+44 (0)20 7946 0958"]
    amex = "3782 822463 10005"
    rows = run(spark, [f"a {x} b" for x in [*cards, *phones, *others, amex, "020 7946 0958", "(030) 12345678"]])
    assert [[x["kind"] for x in r["pii"]] for r in rows] == [["card"]] * 3 + [["phone"]] * 10 + [["card"]] + [["phone"]] * 2
    for r, x in zip(rows, [*cards, *phones, *others, amex, "020 7946 0958", "(030) 12345678"]):
        assert r["text"] == f"a {r['pii'][0]['value']} b" and shape(r["text"]) == shape(f"a {x} b") and x not in r["text"]
    bare = [re.sub("[^0-9]", "", r["pii"][0]["value"]) for r in rows]
    assert len(set(bare[:3])) == 1 and luhn(bare[0]) and luhn(bare[13])
    assert len({x[-10:] for x in bare[3:10]}) == 1
    assert bare[10] == bare[11] == bare[12][:2] + bare[12][3:] and bare[10][:2] == "44" and "(0)" in rows[12]["text"]


def test_groups_beside_other_numbers(spark):
    card = "4111 1111 1111 1111"
    want = run(spark, [card])[0]["text"]
    texts = ["12345 {c} 123", "2021-03-04 {c} 10.0.0.7", "{c} {c}", "{c} 415-555-0132", "123 4111111111111111", "+44 20 7946 0958 190.137.223.204 5"]
    rows = run(spark, [t.format(c=card) for t in texts])
    assert [[x["kind"] for x in r["pii"]] for r in rows] == [["card"], ["date", "card", "ip"], ["card"] * 2, ["card", "phone"], ["card"], ["phone", "ip"]]
    assert rows[0]["text"] == f"12345 {want} 123" and rows[2]["text"] == f"{want} {want}"
    same = "4111 1111 1111 1112, 1234 5678 9012 345, 2020 2021, 1 2 3 4 5 6 7 8 9 10 11 12 13, 31.02.21, 1.2.34, 13/13/2020, 5550132, 10 000 000"
    assert run(spark, [same])[0]["text"] == same
    long = "123456 " * 20_000
    assert run(spark, [f"{long}{card} 7"])[0]["text"].endswith(f" {want} 7")


def test_forms_of_dates(spark):
    full = ["2020-12-31", "2020/12/31", "2020.12.31", "31/12/2020", "12/31/2020", "31.12.2020", "31-12-2020"]
    rows = run(spark, ["; ".join(full), "4.3.2021; 3/4/2021; 2021-3-4; 2021-03-04", "31/12/20; 04.03.21; 3/4/21"])
    assert [len(r["pii"]) for r in rows] == [7, 4, 3]

    def day(v, usual):
        a = [int(x) for x in re.split("[-/.]", v)]
        if len(v.split(re.findall("[-/.]", v)[0])[0]) == 4:
            return datetime.date(*a)
        m, d = a[:2] if usual == "m" and a[0] <= 12 else (a[1], a[0])
        return datetime.date(a[2] if a[2] > 99 else 2000 + a[2] if a[2] < 50 else 1900 + a[2], m, d)

    days = {day(x["value"], "m" if "/" in x["value"] else "d") for x in rows[0]["pii"]}
    assert len(days) == 1
    assert len({day(x["value"], "m" if "/" in x["value"] else "d") for x in rows[1]["pii"]}) == 1
    short = [x["value"] for x in rows[2]["pii"]]
    assert day(short[1], "d") == day(short[2], "m") and all(re.fullmatch(r"\d{1,2}[./]\d{1,2}[./]\d{2}", x) for x in short)


def test_email_digest_is_long(spark):
    assert re.fullmatch(r"u[0-9a-f]{32}@x\.org", run(spark, ["ann@x.org"])[0]["text"])


def test_permutation_is_one_to_one(spark):
    rows = run(spark, [" ".join(f"1.2.{i}.{j}" for j in range(256)) for i in range(8)]
               + [" ".join(f"{2000 + y}-{m:02d}-{d:02d}" for m in range(1, 13) for d in range(1, 29)) for y in range(6)])
    ips = [x["value"] for r in rows[:8] for x in r["pii"]]
    days = [x["value"] for r in rows[8:] for x in r["pii"]]
    assert len(set(ips)) == len(ips) == 8 * 256
    assert len(set(days)) == len(days) == 6 * 12 * 28


def test_odd_rows(odd, empty):
    out = pii.pseudonymize(odd, "k")
    rows = out.collect()
    assert out.columns == [*odd.columns, "pii_"]
    assert sorted((r["doc_id"] or -1, r["text"] or "") for r in rows) == sorted((r["doc_id"] or -1, r["text"] or "") for r in odd.collect())
    assert pii.pseudonymize(empty, "k").count() == 0
    with pytest.raises(ValueError):
        pii.pseudonymize(empty, "a'b")


@pytest.mark.parametrize("text, found", [("a@" + "b." * 100_000 + "c", 1), ("a@" + "b." * 4_000, 1), ("1234 " * 20_000, 0), ("x" * 1_000_000 + "@", 0),
                                         ("1.1.1." * 20_000, 15_000), ("+1" * 100_000, 0), ("(0" * 100_000, 0), ("a." * 100_000 + "@b", 0)])
def test_very_long_candidates(spark, text, found):
    out = pii.pseudonymize(spark.createDataFrame([(1, text)], "doc_id long, text string"), "k1")
    assert out.select(F.size("pii")).first()[0] == found
