from tagloom.plans import catalog_queries as Q

SF = "/root/testdata/sf0.001"


def test_tags_are_compared_once_for_each_pair_of_kinds(spark, monkeypatch):
    made, written = {}, Q.written
    monkeypatch.setattr(Q, "written", lambda df, name: made.setdefault(name, written(df, name)))
    pairs = Q.fits(Q.pairs(spark, SF))
    kinds = {(tuple(r.accords), tuple(r.notes), r.gender, r.wanted, tuple(r.scenarios or ()), tuple(r.families or ()), r.age and (r.age >= 25) + (r.age > 40)) for r in pairs.collect()}
    assert made["tag_fits"].count() == len(kinds) < pairs.count() == made["ordered"].count()
