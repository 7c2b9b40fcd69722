"""Logs of an agent village as events: chat, computer sessions, actions, goals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clip, extract_urls, mentions, no_strings, parse_timestamp, resource_key
from ..plans.frame import canonical
from . import tables
from .wiki import event

#: What an action type becomes; None drops it (told elsewhere, or noise), unknown ones are "other".
ACTIONS = {
    "AGENT_TALK": None, "USER_TALK": None, "START_USING_COMPUTER": None, "STOP_USING_COMPUTER": "session_end", "CONSOLIDATE": "memory_write", "SEARCH_HISTORY": "memory_read",
    "OUTREACH_APPROVAL_REQUEST": "tool_use", "OUTREACH_APPROVAL_RESPONSE": "other", "REQUEST_HUMAN_HELPER": "tool_use", "CANCEL_REQUEST_FOR_HUMAN_HELPER": "tool_use",
    "STOP_HUMAN_USE_SESSION": "session_end", "ENTER_ROOM": "other", "WAIT": None, "PAUSE": None, "USER_NAME_CHANGE": None, "RESTARTING_AFTER_GOOGLE_SIGN_IN": None, "REQUEST_GOOGLE_SIGN_IN": None,
}
HELPER = ("REQUEST_HUMAN_HELPER", "CANCEL_REQUEST_FOR_HUMAN_HELPER")

AGENTS = "id string, name string, model_string string"
AGENT_GOALS = "id string, agent_id string, name string, short_name string, description string, start_time string, end_time string, created_at string"
VILLAGE_GOALS = "id string, goal string, start_time string, end_time string"
ROOMS = "id string, name string"
CHAT = "id string, created_at string, agent_speaker_id string, user_speaker_id string, speaker_type string, content string, room_id string"
SESSIONS = "id string, created_at string, agent_id string, session_goal string, short_displayed_session_goal string, has_been_asked_to_stop boolean"
DATA = "actionType string, agentId string, speakerId string, speakerName string, roomId string, roomName string, computerUseSessionId string, summary string, nextSessionGoal string, query string, answerToQuery string, recipient string, medium string, messageContent string, approval boolean, adminComment string, sessionGoal string, humanConstraints string"
ACTIONS_TABLE = f"id string, created_at string, event_index bigint, data struct<{', '.join(x.replace(' ', ':', 1) for x in DATA.split(', '))}>"
SCHEMAS = {"agents": AGENTS, "agent_goals": AGENT_GOALS, "village_goals": VILLAGE_GOALS, "chat_rooms": ROOMS, "chat_messages": CHAT, "computer_use_sessions": SESSIONS, "events": ACTIONS_TABLE}


def read(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All tables of a folder; one that is missing is empty."""
    out = {}
    for name, schema in SCHEMAS.items():
        path = tables.find(spark, folder, name)
        out[name] = tables.json_lines(spark, path, schema) if path else spark.createDataFrame([], schema)
        if name == "agent_goals":
            place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
            out[name] = out[name].withColumn("listed", place if path else F.lit(None).cast("struct<file_path:string,file_block_start:bigint,row:bigint>"))
    return out


def resources(*texts: Column) -> Column:
    """Different resource keys of the URLs in the texts."""
    urls = F.concat(*[extract_urls(t) for t in texts])
    return F.array_distinct(F.filter(F.transform(urls, lambda u: resource_key(u)), lambda k: k.isNotNull()))


def with_goal(rows: DataFrame, goals: DataFrame, agent: str = "agent", at: str = "at", key: str = "id") -> DataFrame:
    """Rows with ``goal_key``: the agent's goal whose interval holds the time (open where null), the last listed of several.

    ``goals.listed`` orders the goals: :func:`read` sets it to the place in the file, which no partitioning changes.
    """
    g = goals.select(F.col("agent_id").alias("__agent"), parse_timestamp(F.col("start_time")).alias("__from"), parse_timestamp(F.col("end_time")).alias("__to"), "short_name", F.struct("listed", "short_name").alias("__nth"))
    inside = (F.col("__from").isNull() | (F.col("__from") <= F.col(at))) & (F.col("__to").isNull() | (F.col(at) < F.col("__to")))
    held = rows.select(key, agent, at).join(g, (F.col(agent) == F.col("__agent")) & inside).groupBy(key).agg(F.max_by("short_name", "__nth").alias("goal_key"))
    return rows.join(held, key, "left")


def load_window(raw: dict[str, DataFrame], start: str, end: str, max_events: int | None = None, include_humans: bool = True) -> DataFrame:
    """The canonical frame of start <= time < end.

    Chat comes from the chat table and sessions from theirs; their mirrors among the actions are dropped. Names of
    agents active in the window are looked for in texts. Spark broadcasts the lookup tables (agents, rooms, goals) if they are
    small enough.
    """
    c = F.col
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    cut = lambda df: df.withColumn("at", parse_timestamp(c("created_at"))).where((c("at") >= lo) & (c("at") < hi))
    names = raw["agents"].select(c("id").alias("agent"), c("name").alias("agent_name"))
    rooms = raw["chat_rooms"].select(c("id").alias("room_id"), c("name").alias("room_label"))
    goals = raw["agent_goals"]
    chat, sessions, actions = cut(raw["chat_messages"]), cut(raw["computer_use_sessions"]), cut(raw["events"]).select("id", "at", "event_index", "data.*")
    active = chat.select(c("agent_speaker_id").alias("agent")).unionByName(sessions.select(c("agent_id").alias("agent"))).where("agent is not null").distinct().join(names, "agent").select("agent_name").distinct()
    known = sorted(r[0] for r in active.collect() if r[0])  # names of the agents of one village
    users = actions.where("actionType = 'USER_TALK' and speakerId is not null and speakerName is not null").groupBy(c("speakerId").alias("user")).agg(F.max_by("speakerName", "at").alias("user_name"))
    # Chat
    is_agent = F.coalesce((c("speaker_type") == "agent") & c("agent_speaker_id").isNotNull(), F.lit(False))
    m = chat.withColumn("is_agent", is_agent).withColumn("agent", F.when(c("is_agent"), c("agent_speaker_id"))).withColumn("user", F.when(~c("is_agent"), F.coalesce("user_speaker_id", F.lit("unknown"))))
    m = with_goal(m.join(names, "agent", "left").join(users, "user", "left").join(rooms, "room_id", "left"), goals)
    actor = F.when(c("is_agent"), F.coalesce("agent_name", "agent")).otherwise(F.concat(F.lit("human:"), F.coalesce("user_name", F.substring("user", 1, 8))))
    m = m.withColumn("actor", actor).withColumn("text", F.coalesce("content", F.lit("")))
    parts = [event(
        m, event_id=F.concat(F.lit("chat:"), "id"), timestamp=c("at"), actor_id=c("actor"), actor_type=F.when(c("is_agent"), "agent").otherwise("human"), action_type=F.lit("message"), target_id=c("room_id"), target_type=F.lit("room"), content=clip(c("text"), 2000),
        source=F.lit("ai_village:chat_messages"), mentions=mentions(c("text"), known, c("actor")), resources=resources(c("text")), goal_key=c("goal_key"), actor_name=c("actor"), room_name=F.coalesce("room_label", "room_id"), raw_id=c("id"))]
    # Sessions
    s = with_goal(sessions.where("agent_id is not null").withColumnRenamed("agent_id", "agent").join(names, "agent", "left"), goals)
    s = s.withColumn("actor", F.coalesce("agent_name", "agent")).withColumn("goal", F.coalesce("session_goal", F.lit(""))).withColumn("short", F.coalesce("short_displayed_session_goal", F.lit("")))
    parts.append(event(
        s, event_id=F.concat(F.lit("session:"), "id"), timestamp=c("at"), actor_id=c("actor"), actor_type=F.lit("agent"), action_type=F.lit("session_start"), target_id=c("id"), target_type=F.lit("session"),
        content=clip(F.concat(F.when(c("short") != "", F.concat("short", F.lit(" — "))).otherwise(""), "goal"), 1500), source=F.lit("ai_village:computer_use_sessions"), tool=F.lit("computer"), mentions=mentions(c("goal"), known, c("actor")),
        resources=resources(c("goal")), goal_key=c("goal_key"), actor_name=c("actor"), target_label=F.when(c("short") != "", c("short")).otherwise(F.substring("id", 1, 8)), raw_id=c("id")))
    # Actions
    dropped = [k for k, v in ACTIONS.items() if v is None]
    table = F.create_map(*[F.lit(x) for k, v in ACTIONS.items() if v for x in (k, v)])
    a = actions.where(~F.coalesce(c("actionType").isin(*dropped), F.lit(False))).withColumn("action", F.coalesce(table[c("actionType")], F.lit("other")))
    a = a.withColumn("agent", F.coalesce(F.nullif("agentId", F.lit("")), F.nullif("speakerId", F.lit(""))))
    a = with_goal(a.join(names, "agent", "left").join(rooms.withColumnRenamed("room_id", "roomId"), "roomId", "left"), goals)
    kind, text = c("actionType"), lambda x: F.coalesce(x, F.lit(""))
    answer, helper = F.coalesce(kind == "OUTREACH_APPROVAL_RESPONSE", F.lit(False)), F.coalesce(kind.isin(*HELPER), F.lit(False))
    named = F.coalesce("agent_name", "agent")
    a = a.withColumn("named", named).withColumn("actor", F.when(answer, "human:outreach_reviewer").otherwise(F.coalesce("named", F.lit("system"))))
    a = a.withColumn("kind_of", F.when(answer, "human").when(c("agent").isNotNull(), "agent").otherwise("system"))
    content = (
        F.when(kind.isin("STOP_USING_COMPUTER", "STOP_HUMAN_USE_SESSION"), text("summary")).when(kind == "CONSOLIDATE", text("nextSessionGoal")).when(kind == "SEARCH_HISTORY", F.concat(text("query"), F.lit("\n→ "), text("answerToQuery")))
        .when(kind == "OUTREACH_APPROVAL_REQUEST", F.concat(F.lit("[outreach request to "), F.coalesce("recipient", F.lit("None")), F.lit(" via "), F.coalesce("medium", F.lit("None")), F.lit("] "), text("messageContent")))
        .when(answer, F.concat(F.lit("[outreach "), F.when(c("approval"), "APPROVED").otherwise("REJECTED"), F.lit(" for "), F.coalesce("named", F.lit("None")), F.lit("] "), text("adminComment")))
        .when(helper, F.trim(F.concat(text("sessionGoal"), F.lit(" "), text("humanConstraints")))).otherwise("")
    )
    target = F.when(kind == "STOP_USING_COMPUTER", c("computerUseSessionId")).when(kind == "CONSOLIDATE", c("actor")).when(kind == "SEARCH_HISTORY", "village_history").when(answer, c("named")).when(kind == "ENTER_ROOM", c("roomId"))
    target_type = F.when(kind == "STOP_USING_COMPUTER", F.when(c("computerUseSessionId").isNotNull(), "session")).when(kind.isin("CONSOLIDATE", "SEARCH_HISTORY"), "memory").when(answer, "agent").when(kind == "ENTER_ROOM", "room")
    tool = F.when(kind == "SEARCH_HISTORY", "search_history").when(kind == "OUTREACH_APPROVAL_REQUEST", "external_outreach").when(helper | F.coalesce(kind == "STOP_HUMAN_USE_SESSION", F.lit(False)), "human_helper")
    a = a.withColumn("text", content)
    parts.append(event(
        a, event_id=F.concat(F.lit("event:"), "id"), timestamp=c("at"), actor_id=c("actor"), actor_type=c("kind_of"), action_type=c("action"), target_id=target, target_type=target_type, content=clip(c("text"), 2000), source=F.concat(F.lit("ai_village:events:"), F.coalesce(kind, F.lit("None"))),
        tool=tool, mentions=mentions(c("text"), known, c("actor")), resources=resources(c("text"), c("medium")), goal_key=F.when(c("kind_of") == "agent", c("goal_key")), actor_name=c("actor"), room_name=F.coalesce("room_label", "roomId"), raw_id=c("id")))
    # Goals
    g = goals.withColumn("at", F.coalesce(parse_timestamp(c("start_time")), parse_timestamp(c("created_at")))).where((c("at") >= lo) & (c("at") < hi)).withColumnRenamed("agent_id", "agent").join(names, "agent", "left")
    who = F.coalesce("agent_name", "agent")
    parts.append(event(
        g, event_id=F.concat(F.lit("agent_goal:"), "id"), timestamp=c("at"), actor_id=who, actor_type=F.lit("agent"), action_type=F.lit("goal_set"), target_id=c("short_name"), target_type=F.lit("goal"), content=F.trim(F.concat("name", F.lit(" "), text("description"))),
        source=F.lit("ai_village:agent_goals"), goal_key=c("short_name"), actor_name=who, raw_id=c("id")))
    v = raw["village_goals"].withColumn("at", parse_timestamp(c("start_time"))).where((c("at") >= lo) & (c("at") < hi))
    parts.append(event(v, event_id=F.concat(F.lit("village_goal:"), "id"), timestamp=c("at"), actor_id=F.lit("village"), actor_type=F.lit("system"), action_type=F.lit("goal_set"), target_id=F.lit("village_goal"), target_type=F.lit("goal"), content=c("goal"), source=F.lit("ai_village:village_goals"), raw_id=c("id")))
    every = reduce(DataFrame.unionByName, parts)
    if not include_humans:
        every = every.where("actor_type <> 'human'")
    if max_events is not None:
        every = every.orderBy("timestamp", "event_id").limit(max_events)
    return canonical(every)


def active_village_goals(raw: dict[str, DataFrame], start: str, end: str) -> DataFrame:
    """Goals whose interval meets the window."""
    g = raw["village_goals"].withColumn("from", parse_timestamp(F.col("start_time"))).withColumn("to", parse_timestamp(F.col("end_time")))
    return g.where((F.col("from") <= F.lit(end).cast("timestamp")) & (F.col("to").isNull() | (F.col("to") >= F.lit(start).cast("timestamp")))).select("goal", "from", "to")


def nearby_changes(log: DataFrame, start: str, end: str) -> DataFrame:
    """Sections of the change log from three days before the window to one day after."""
    return log.where((F.col("day") >= F.date_sub(F.lit(start).cast("date"), 3)) & (F.col("day") <= F.date_add(F.lit(end).cast("date"), 1)))


def daily_activity(chat: DataFrame) -> DataFrame:
    """(day, messages, speakers, url_messages); a message's speaker is its agent or else its user."""
    speaker = F.coalesce(F.nullif("agent_speaker_id", F.lit("")), F.nullif("user_speaker_id", F.lit("")))
    day = F.to_date(parse_timestamp(F.col("created_at"))).alias("day")
    return chat.groupBy(day).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct(speaker).alias("speakers"), F.sum(F.coalesce(F.col("content").contains("http"), F.lit(False)).cast("long")).alias("url_messages"))


def cached_daily_activity(spark: SparkSession, path: str) -> DataFrame:
    """:func:`daily_activity` of a slim cache of chat messages; the scan reads time and payload only."""
    said = F.from_json("payload", "agent_speaker_id string, user_speaker_id string, content string").alias("said")
    return daily_activity(tables.read_columns(spark, path, "ts", "payload").select(F.col("ts").cast("string").alias("created_at"), said).select("created_at", "said.*"))


def slice_context(raw: dict[str, DataFrame], log: DataFrame, start: str, end: str, max_events: int | None = None, include_humans: bool = True) -> DataFrame:
    """One row on a window: its bounds, whether ``max_events`` cuts it, rows of each table in it, goals and changes of the time.

    Goals are in the order of their beginnings, changes in that of their days.
    """
    lo, hi = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    inside = lambda name: raw[name].withColumn("at", parse_timestamp(F.col("created_at"))).where((F.col("at") >= lo) & (F.col("at") < hi)).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
    counts = reduce(DataFrame.unionByName, [inside(t) for t in ("chat_messages", "computer_use_sessions", "events")]).agg(F.map_from_entries(F.collect_list(F.struct("name", "n"))).alias("raw_rows"))
    goals = active_village_goals(raw, start, end).agg(F.array_sort(F.collect_list(F.struct("from", "goal"))).getField("goal").alias("active_village_goals"))
    changes = nearby_changes(log, start, end).agg(F.array_sort(F.collect_list(F.struct("day", "body"))).alias("nearby_changes"))
    over = F.lit(False)
    if max_events is not None:
        kept = load_window(raw, start, end, None, include_humans).limit(max_events + 1)
        counts = counts.crossJoin(kept.agg(F.count(F.lit(1)).alias("kept")))  # one row each, as below
        over = F.col("kept") > max_events
    return counts.crossJoin(goals).crossJoin(changes).select(lo.alias("window_start"), hi.alias("window_end"), over.alias("truncated_to_max_events"), "raw_rows", "active_village_goals", "nearby_changes")


def busiest_days(activity: DataFrame, most: int = 25) -> DataFrame:
    return activity.orderBy(F.desc("messages"), "day").limit(most)

