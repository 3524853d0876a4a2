"""Explicit schemas of the nested JSON books; inference would take empty arrays for arrays of strings."""

from __future__ import annotations

from pyspark.sql import types as T

S, I = T.StringType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


REFERENCE = _struct(paragraphIndex=I, start=I, end=I)
FOOTNOTE = _struct(id=S, marker=S, content=T.ArrayType(S), references=T.ArrayType(REFERENCE), imageAsset=S, imageSha256=S, sourceUrl=S, status=S)
SECTION = _struct(id=S, title=S, level=I, paragraphIndex=I)
TEXT_REPAIR = _struct(id=S, paragraphIndex=I, start=I, end=I, text=S, sourceRawSha256=S)
CHAPTER = _struct(id=S, title=S, level=I, content=T.ArrayType(S), footnotes=T.ArrayType(FOOTNOTE), sections=T.ArrayType(SECTION), sourceTextRepairs=T.ArrayType(TEXT_REPAIR))
TOC_NODE = _struct(id=S, parentId=S, title=S, type=S, order=I, chapterId=S, paragraphIndex=I, counterpartKey=S, level=I)
AUTHOR = _struct(id=S, nameZh=S, nameEn=S, years=S, description=S, color=S, sourceBookIds=T.ArrayType(S))
BOOK = _struct(
    id=S, titleZh=S, titleEn=S, language=S, category=S, sourceUrl=S, sourceCredit=S, translator=S, rights=S, description=S, year=S, authorIds=T.ArrayType(S), seriesId=S,
    yearType=S, yearBasis=S, yearEvidenceUrl=S, yearNote=S, publicationDate=S, publicationDateEnd=S, publicationDateBasis=S, publicationDateSourceUrl=S, publicationDateNote=S,
    translatorBasis=S, translatorEvidenceUrl=S, translationYear=S, editionNote=S, chapters=T.ArrayType(CHAPTER), toc=T.ArrayType(TOC_NODE),
)
LIBRARY = _struct(schemaVersion=I, authors=T.ArrayType(AUTHOR), books=T.ArrayType(BOOK), _corrupt=S)
