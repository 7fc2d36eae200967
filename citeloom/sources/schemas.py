"""Columns of the domain's tables. Texts stay texts: identifiers such as 55/2 are never inferred as dates or numbers."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, FloatType, LongType, StringType, StructField, StructType

#: The columns of the domain's tables, down to VECTOR.
_META = "res_id3 res_id2_unlet alt_id_dic session_type session_reg session_sp session_es resn res_letter date_p date_c location topic filename content".split()
RESOLUTION = ["res_id2", *_META, "record", "draft", "n_inc_cit"]
#: Columns of a resolution that an edge holds of its giving and of its receiving end.
GIVING = [f"{c}_giv" for c in _META]
RECEIVING = [f"{c}_recv" for c in _META if c != "res_id2_unlet"]
CITATION = ["res_id2_doc_giving_cite", "res_id2_unlet_recv", *GIVING, "cited_res", "cited_res_conv", "n_outg_cit", "res_id2_doc_receiv_cite", *RECEIVING]
SUBJECT = "res_id title symbol session_year subject downloads url".split()
INSTRUMENT = ["title", "adopted_text", "url"]
INSTRUMENT_DETAILED = ["title", "url", "adopted_by", "content", "pdf_url"]
COUNCIL_RESOLUTION = ["year", "code", "adoption", "title", "url"]
CONVENTION = ["code", "title", "year", "number"]


def texts(columns: list[str]) -> StructType:
    """All columns as nullable strings."""
    return StructType([StructField(c, StringType()) for c in columns])


NEW_EDGE = texts(["res_id2_doc_giving_cite", "res_id2_unlet_recv"])
VECTOR = StructType([StructField("doc_id", StringType()), StructField("content", StringType()), StructField("vec", ArrayType(FloatType())), StructField("pos", LongType())])
