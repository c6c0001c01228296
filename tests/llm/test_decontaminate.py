from ledgerproof.llm import decontaminate

ITEM = "If Anna buys 12 kg of apples for 30 dollars how much does Bernard pay for 5 kg of the same apples at the market"
OTHER = "which of the following rivers flows through the largest number of countries before it reaches the black sea coast"


def test_leaks(spark, none, odd):
    items = spark.createDataFrame([(1, ITEM), (2, OTHER), (3, None), (4, ""), (5, "short and sweet text"), (6, OTHER)], "item_id long, text string")
    noise = "some words that stand around a passage and mean nothing in particular "
    docs = spark.createDataFrame(
        [
            (10, noise + ITEM + " " + noise), (11, noise + ITEM.replace("12", "45").replace("Anna", "Zoe").replace("30", "99").replace("Bernard", "Carl")),
            (12, noise + OTHER.upper()), (13, noise * 50), (14, None), (15, ""), (16, "short and sweet text"), (17, OTHER[20:]), (None, OTHER),
            (18, "If Anna sells 12 kg of pears"), (19, ITEM.lower()), (10, ITEM), (20, (ITEM + " ") * 300),
        ],
        "doc_id long, text string",
    ).repartition(3)
    got = {(r.doc_id, r.item_id): r for r in decontaminate.leaks(docs, items).collect()}
    assert {k[0] for k in got} == {10, 11, 12, 16, 17, 19, 20}
    assert (12, 2) in got and (12, 6) in got and (10, 2) not in got
    assert not got[10, 1].reparametrized and got[11, 1].reparametrized and got[11, 1].coverage > 0.9
    assert got[10, 1].coverage == 1 and got[17, 2].coverage < 1
    kept = decontaminate.decontaminate(docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [13, 14, 15, 18]  # the row without an id holds an item
    assert decontaminate.leaks(none, items).count() == 0 and decontaminate.decontaminate(odd, items.filter("false")).count() == odd.count()
    assert decontaminate.decontaminate(odd, items).columns == odd.columns


def test_slots_must_agree(spark):
    """One name of the item can't stand for several names of the document."""
    item = "Anna gave Bernard the red book then Anna took the blue pen and Anna left Bernard there with Anna and the rest"
    mixed = "Zoe gave Carl the red book then Mia took the blue pen and Lea left Tom there with Eve and the rest"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, item), (2, item.replace("Anna", "Zoe").replace("Bernard", "Carl")), (3, mixed)], "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.leaks(docs, items).collect()} == {1, 2}


def test_chance_phrases(spark):
    words = "the of and to in a is that it for on was be with as by at an or from".split()
    docs = spark.createDataFrame([(i, " ".join(words[(i * 7 + k * (i % 5 + 1)) % 20] for k in range(200))) for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, ITEM), (2, OTHER)], "item_id long, text string")
    assert decontaminate.leaks(docs, items).count() == 0


def test_new_values_may_coincide(spark):
    """Different values of the item may stand for one value of the document, typed and folded."""
    item = "Mary has 3 red apples and 5 green pears in the big basket on the old kitchen table today"
    docs = spark.createDataFrame([(1, item.replace("3", "4").replace("5", "4")), (2, item.replace("3", "4").replace("5", "4").lower())], "doc_id long, text string")
    got = decontaminate.leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert {r.doc_id for r in got} == {1, 2} and all(r.reparametrized and r.consistency == 1 for r in got)


def test_items_of_numbers(spark):
    """Copies of items that hold hardly a word are found; with other numbers only those whose signs make a template."""
    texts = [(1, "Compute 12 + 45 - 7 * 3"), (2, "2 4 8 16 32 64 128 256 512 1024 2048 4096"), (3, "17 + 4 = 21, 9 * 5 = 45, 81 / 9 = 9")]
    docs = [(i, f"as an aside {t} and so on") for i, t in texts] + [(4, "Compute 11 + 46 - 8 * 2"), (5, "2 4 8 16 32 65 128 256 513 1024 2049 4096"), (6, "compute 12 + 45 - 7 * 3")]
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(texts, "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == {(1, 1), (2, 2), (3, 3), (4, 1), (6, 1)}
