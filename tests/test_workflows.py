import os

from conftest import rows
from tessera.operators import space as SP
from tessera.plans import workflows as W


def test_profile_to_relation_space(spark, tmp_dir):
    d = tmp_dir + "/prof"
    os.makedirs(d)
    with open(d + "/object_akp.txt", "w") as f:
        f.write("Org;hq;City;50\nOrg;located;City;11\nSubOrg;hq;City;20\nSubOrg;located;City;13\n"
                "Org;hq;Lake;30\nPerson;spouse;Person;40\nPerson;knows;Person;17\nOrg;spouse;Person;15\n"
                "Org;knows;Person;18\nPerson;wikiLink;Org;90\nX;lonely;Y;99\n")
    with open(d + "/datatype_akp.txt", "w") as f:
        f.write("Org;hq;Lake;12\n")
    sub = spark.createDataFrame([("SubOrg", "Org")], "child string, parent string")
    eq = spark.createDataFrame([], "a string, b string")
    from tessera.operators.derive import Rule
    prof = W.profile_table(spark, d, sub, eq, eq, rules=[Rule("org:hq_city", ["hq"], ["Org"], objects=["City"])])
    preds = {r["predicate"] for r in prof.select("predicate").distinct().collect()}
    assert preds == {"hq", "located", "spouse", "knows", "org:hq_city"}
    with open(tmp_dir + "/plist.txt", "w") as f:
        f.write("hq\nspouse\norg:hq_city\nnone\n\nignored\n")
    space = W.relation_space(spark, prof, tmp_dir + "/plist.txt", clones=["hq_@1", "hq_@2"])
    sums = {r["predicate"]: round(r["row_sum"], 9) for r in SP.row_sums(space).collect()}
    assert set(sums) == {"spouse", "org:hq_city", "none", "hq_@1", "hq_@2", "no_relation"}
    # (Org, hq, Lake) is in both files: both count in the total (112), only
    # the first row's probability is used, so the hq row sums to 100/112
    assert sums["hq_@1"] == round(1 + 100 / 112, 9) and sums["none"] == 0.0 and sums["spouse"] == 1.0
    assert rows(space.rows, "row_order", "predicate")[-1] == (5, "no_relation")
