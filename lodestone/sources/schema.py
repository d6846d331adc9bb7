"""The canonical document, and the other stored tables, as Spark types."""

from __future__ import annotations

from pyspark.sql import types as T

_S = T.StringType()
CANONICAL = T.StructType(
    [T.StructField(n, _S) for n in ("source_type", "source_id", "url", "title", "body", "created_at", "updated_at", "resolved_at", "status")]
    + [T.StructField("labels", T.ArrayType(_S)), T.StructField("version_min", _S), T.StructField("version_max", _S), T.StructField("component", _S)]
    + [T.StructField("component_versions", T.MapType(_S, _S)), T.StructField("reliability", T.DoubleType()), T.StructField("kind", _S), T.StructField("verification", _S), T.StructField("extra", T.MapType(_S, _S))]
)
#: Fixed value: the fields of a raw item as the connectors write it.
RAW_ITEM = "number bigint, title string, body string, labels array<struct<name:string>>, state string, created_at string, updated_at string, closed_at string, html_url string, pull_request struct<merged:boolean,merged_at:string,merge_commit_sha:string>"
RAW_COMMENTS = "user struct<login:string>, created_at string, body string"
CALENDAR = "repo string, releases array<struct<tag:string,date:string,prerelease:boolean,kind:string>>"
TABLES = "source string, encrypted boolean, text string, sections array<struct<title:string,text:string>>, tables array<struct<page:int,index:int,rows:array<array<string>>>>"
#: The tables of the graph and of the review queue.
NODE_ISSUE = "id string, repo string, number bigint, title string, status string, created_at string, resolved_at string, url string"
NODE_REQUEST = "id string, repo string, number bigint, title string, status string, merged_at string, url string"
NODE_DOCUMENT, NODE_RELEASE = "id string, source_type string, title string", "id string, repo string, tag string, date timestamp, kind string"
NODE_ENTITY, EDGE, EDGE_KIND = "id string", "src string, dst string", "src string, kind string, dst string"
REVIEW_EVENT = "id bigint, item string, category string, status string, at timestamp, reviewer string, payload string"
