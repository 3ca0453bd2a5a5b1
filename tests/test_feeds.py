"""Feeds as XML, and entities by name and number."""

from pyspark.sql import functions as F

from foliate.sources import readers

ENTRY = "<entry><id>http://arxiv.org/abs/2101.1v2/</id><title>A &#8217;\n &#x2014; <![CDATA[<b> & c]]></title><published>2021-01-02T00:00:00Z</published><author><name> Ann  B </name></author><author><name/></author><summary type='text'>s &amp; t</summary></entry>"


def test_atom(spark):
    prefixed = '<a:feed xmlns:a="http://www.w3.org/2005/Atom" xmlns:o="urn:o"><a:title>feed</a:title>' + ENTRY.replace("</", "</a:").replace("<", "<a:").replace("<a:/a:", "</a:").replace("<a:/", "</").replace("<a:![CDATA[<a:b>", "<![CDATA[<b>") + "<o:entry><o:id>no</o:id></o:entry></a:feed>"
    feeds = [f'<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">{ENTRY}<entry><id>z</id></entry></feed>', prefixed, ENTRY, "broken <entry>", "", None]
    rows = readers.atom_records(spark.createDataFrame(list(enumerate(feeds)), "i int, raw string")).orderBy("i", "record_id").collect()
    assert [(r.i, r.record_id) for r in rows] == [(0, "arxiv:2101.1v2"), (0, "arxiv:z"), (1, "arxiv:2101.1v2"), (2, "arxiv:2101.1v2")]
    for r in (rows[0], rows[2], rows[3]):
        assert (r.title, r.authors, r.year, r.publication_date, r.abstract) == ("A ’ — <b> & c", ["Ann B"], 2021, "2021-01-02", "s & t")
    assert (rows[1].title, rows[1].authors, rows[1].year, rows[1].abstract) == ("", [], None, None)


def test_entities(spark):
    texts = [("caf&eacute; &#8217; &#x2014; &amp;lt; &nosuch; &copy", "café ’ — &lt; &nosuch; ©"), ("plain", "plain"), (None, None)]
    found = spark.createDataFrame([(i, a) for i, (a, _) in enumerate(texts)], "i int, t string").orderBy("i").select(readers.unescape(F.col("t")).alias("o"))
    assert [r.o for r in found.collect()] == [b for _, b in texts]
