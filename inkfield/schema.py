"""Schemas of blocks, pages, wire documents and results."""

BOX = "struct<x1:double,y1:double,x2:double,y2:double>"
BLOCKS = "doc_id string, page int, block_idx int, text string, confidence double, x1 double, y1 double, x2 double, y2 double"
WIRE = (
    "doc_id string, success boolean, duration_ms int, engine string, "
    f"pages array<struct<page:int,width:int,height:int,applied_rotation:double,blocks:array<struct<text:string,confidence:double,box:{BOX},polygon:array<array<double>>>>>>"
)
FIELDS = ("vkn", "tckn", "ticaretUnvani", "adiSoyadi", "vergiDairesi", "adres", "iseBaslamaTarihi", "anaFaaliyetKodu", "anaFaaliyetAciklamasi")
WARNING = "struct<code:string,field:string>"
VALIDITY = "struct<valid:boolean,reason:string>"
RESULT = (
    "doc_id string, success boolean, document_type string, error string, "
    + "data struct<" + ",".join(f"{f}:string" for f in (*FIELDS[:8], "anaFaaliyetKoduRaw", FIELDS[8])) + ">, "
    + f"validation struct<vkn:{VALIDITY},tckn:{VALIDITY},iseBaslamaTarihi:{VALIDITY}>, "
    + "confidence struct<overall:double,documentType:double," + ",".join(f"{f}:double" for f in FIELDS) + ">, "
    + f"warnings array<{WARNING}>, cause string"
)
RAW = "raw_blocks array<struct<page:int,text:string,confidence:double,x1:double,y1:double,x2:double,y2:double>>, raw_pages array<struct<page:int,width:int,height:int,applied_rotation:double>>"
