"""Schemas of the records that flow through the engine, as DDL. Nothing is inferred at run time."""

from __future__ import annotations

VOICES = "array<struct<name: string, news: boolean, gender: string>>"
LANGUAGE = f"code string NOT NULL, items {VOICES}, translate string NOT NULL"
OUTPUTS = "map<string, struct<url: string>>"
CONTENT = f"uuid string NOT NULL, url string, article_status string, title string, outputs {OUTPUTS}, article_id string, type string, language string, createdAt timestamp, updatedAt timestamp"
TASK = "uuid string NOT NULL, url string, token string, ttl bigint, task_status string, createdAt timestamp, updatedAt timestamp"
#: Columns of kept articles and tasks but their key.
CONTENT_COLUMNS, TASK_COLUMNS = (x.partition(", ")[2] for x in (CONTENT, TASK))
ARTICLE = "uuid string NOT NULL, url string, title string, byline string, text string"
REQUEST = "contentId string, href string, language string"
HTTP_EVENT = "httpMethod string, pathParameters struct<contentId: string>, body string"
CHANGE = "eventName string, dynamodb struct<NewImage: struct<uuid: struct<S: string>, url: struct<S: string>>>"
NOTIFICATION = "eventName string, s3 struct<bucket: struct<name: string>, object: struct<key: string>>"
_AUDIO = "struct<SynthesisTask: struct<TaskId: string, OutputUri: string>>"
WAIT = f"textType string, token string, title {_AUDIO}, audioOutput {_AUDIO}"
MERGE = "uuid string, title string, text array<struct<url: string>>, language string, token string"

# The states of an article and of a task.
CONTENT_STATUS = ("PENDING", "RENDERED", "DELIVERED", "FAILED")
TASK_STATUS = ("PENDING", "DELIVERED")
