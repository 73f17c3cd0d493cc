"""Explicit schemas of everything read from text.

Numbers inside documents are read as text and cast one by one: a wrong type then
costs that value only, not the record.
"""

FEED_RECORD = (
    "struct<id:string, name:string, matchType:string, status:string, venue:string, date:string, "
    "dateTimeGMT:string, teams:array<string>, tossWinner:string, tossChoice:string, "
    "matchStarted:string, matchEnded:string, "
    "score:array<struct<r:string, w:string, o:string, inning:string>>>"
)
FEED_PAGE = f"status string, info map<string, string>, data array<{FEED_RECORD}>"
