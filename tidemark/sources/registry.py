"""The tracked funds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Label, manager and cik of every tracked fund.
TRACKED_FUNDS = [
    ("Berkshire Hathaway", "Warren Buffett", "1067983"),
    ("Scion Asset Mgmt", "Michael Burry", "1649339"),
    ("Pershing Square", "Bill Ackman", "1336528"),
    ("Bridgewater", "Ray Dalio (firm)", "1350694"),
    ("Baupost Group", "Seth Klarman", "1061768"),
    ("Duquesne FO", "Stanley Druckenmiller", "1536411"),
    ("Himalaya Capital", "Li Lu", "1709323"),
    ("Appaloosa", "David Tepper", "1656456"),
    ("Greenlight", "David Einhorn", "1489933"),
    ("Lone Pine", "Stephen Mandel", "1061165"),
    ("Third Point", "Dan Loeb", "1040273"),
    ("Akre Capital", "Chuck Akre", "1112520"),
    ("Value Act", "Jeff Ubben/ValueAct", "1418814"),
    ("Oakmark/Harris", "Bill Nygren", "813917"),
    ("Tiger Global", "Chase Coleman", "1167483"),
    ("Coatue", "Philippe Laffont", "1135730"),
    ("Viking Global", "Andreas Halvorsen", "1103804"),
    ("Icahn", "Carl Icahn", "0921669"),
    ("Trian", "Nelson Peltz", "1345471"),
    ("Soros", "Soros (FO)", "1029160"),
    ("Fairholme", "Bruce Berkowitz", "1056831"),
    ("Oaktree", "Howard Marks", "949509"),
    ("FPA / Romick", "Steven Romick", "1377581"),
    ("Dodge & Cox", "Dodge & Cox", "200217"),
    ("Davis Advisors", "Chris Davis", "1036325"),
    ("Ruane Cunniff", "Sequoia Fund", "89043"),
    ("Gardner Russo", "Tom Russo", "860643"),
    ("TCI", "Chris Hohn", "1647251"),
    ("Polen Capital", "Polen Capital", "1034524"),
    ("Elliott", "Paul Singer", "1791786"),
    ("Starboard Value", "Jeff Smith", "1517137"),
    ("JANA Partners", "Barry Rosenstein", "1998597"),
    ("Sachem Head", "Scott Ferguson", "1582090"),
    ("Eminence", "Ricky Sandler", "1107310"),
    ("Whale Rock", "Alex Sacerdote", "1387322"),
    ("Altimeter", "Brad Gerstner", "1541617"),
    ("D1 Capital", "Dan Sundheim", "1747057"),
    ("Light Street", "Glen Kacher", "1569049"),
    ("Renaissance Tech", "Jim Simons (firm)", "1037389"),
    ("Citadel Advisors", "Ken Griffin", "1423053"),
    ("Millennium", "Izzy Englander", "1273087"),
    ("AQR Capital", "Cliff Asness", "1167557"),
    ("Two Sigma", "Two Sigma", "1179392"),
    ("D. E. Shaw", "D. E. Shaw", "1009207"),
    ("Point72", "Steve Cohen", "1603466"),
    ("Farallon", "Farallon", "0909661"),
]


def tracked_funds(spark: SparkSession) -> DataFrame:
    """(cik, label, manager) of the tracked funds, a small dimension table."""
    rows = [(cik.zfill(10), label, manager) for label, manager, cik in TRACKED_FUNDS]
    return spark.createDataFrame(rows, "cik string, label string, manager string")
