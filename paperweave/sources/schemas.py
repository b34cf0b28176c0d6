"""Explicit schemas of raw records (Spark DDL)."""

CODED = "struct<value:string,label:string,code:string,name:string>"
PID = "array<struct<scheme:string,value:string>>"
AUTHOR = (
    "array<struct<fullname:string,name:string,surname:string,rank:bigint,"
    "pid:struct<id:struct<scheme:string,value:string>,provenance:string>>>"
)

PUBLICATION = (
    f"id string, type string, maintitle string, description array<string>, publicationdate string, "
    f"bestaccessright struct<code:string,label:string,scheme:string>, "
    f"container struct<issnLinking:string,issnOnline:string,issnPrinted:string,name:string>, "
    f"pid {PID}, originalId array<string>, "
    f"subjects array<struct<provenance:string,subject:struct<scheme:string,value:string>>>, "
    f"author {AUTHOR}, instance array<struct<url:array<string>,type:string>>, "
    f"language struct<code:string,label:string>, publisher string, source array<string>"
)
ORGANIZATION = (
    f"id string, legalname string, legalshortname string, officialname string, country struct<code:string,label:string>, "
    f"pid {PID}, websiteurl string, city string, type string"
)
RELATION = (
    "source string, target string, sourceType string, targetType string, "
    "reltype struct<name:string,type:string>, provenance string, validated boolean, validationDate string"
)
DATASOURCE = "id string, officialname string, datasourcetype struct<scheme:string,value:string>, journal struct<name:string>"
PROJECT = (
    "id string, code string, title string, "
    "funding array<struct<funding_stream:string,jurisdiction:string,name:string,shortName:string>>, "
    "granted struct<currency:string,fundedamount:double,totalcost:double>"
)
COMMUNITY = "id string, acronym string, name string, type string, subject array<string>"

# Records of the paged service, which spells its fields in camel case.
SERVICE_PUBLICATION = (
    f"id string, type string, mainTitle string, descriptions array<string>, publicationDate string, "
    f"bestAccessRight struct<code:string,label:string,scheme:string>, container struct<name:string>, "
    f"pids {PID}, originalIds array<string>, "
    f"authors array<struct<fullName:string,name:string,surname:string,rank:bigint,"
    f"pid:struct<id:struct<scheme:string,value:string>>>>, "
    f"organizations array<struct<id:string,legalName:string,acronym:string,pids:{PID}>>, "
    f"sources array<string>, instances array<struct<url:array<string>>>, publisher string, "
    f"language struct<code:string,label:string>"
)
PAGE = (
    "header struct<numFound:bigint,page:bigint,pageSize:bigint,nextCursor:string>, results array<{element}>"
)


def page_schema(element_fields: str) -> str:
    """Schema of one landed result page whose items have the given fields."""
    struct = ", ".join(element_fields.split(", "))
    parts = []
    depth, start = 0, 0
    for i, ch in enumerate(struct):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            parts.append(struct[start:i].strip())
            start = i + 1
    parts.append(struct[start:].strip())
    item = "struct<" + ",".join(p.replace(" ", ":", 1) for p in parts) + ">"
    return PAGE.format(element=item)
