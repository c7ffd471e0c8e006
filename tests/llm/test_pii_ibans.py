"""Valid IBANs of countries all over the registry."""

from pyspark.sql import functions as F

from kdframe.llm import pii

IBANS = """UA213223130000026007233566001 RS35260005601001611379 KZ86125KZT5004100100 QA58DOHB00001234567890ABCDEFG
    BR1800360305000010009795493C1 PK36SCBL0000001123456702 TN5910006035183598478831 GE29NB0000000101904917
    ME25505000012345678951 MK07250120000058984 MD24AG000225100013104168 BA391290079401028494
    KW81CBKU0000000000001234560101 DE89370400440532013000""".split()


def test_ibans_of_all_countries(spark):
    rows = [(i, f"IBAN {text}.") for i, text in enumerate(IBANS)]
    rows += [(100 + i, f"IBAN {text[:2]}{98 - int(text[2:4]):02}{text[4:]}.") for i, text in enumerate(IBANS)]
    found = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", pii.listed(F.col("pii")).alias("spans"))
    got = {r["doc_id"]: r["spans"] for r in found.collect()}
    assert all(f"iban:5:{5 + len(text)}" in got[i] for i, text in enumerate(IBANS))
    assert not any("iban" in got[100 + i] for i in range(len(IBANS)) if IBANS[i][2:4] != "49")
