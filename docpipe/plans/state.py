"""Queries over tasks, parts, jobs, usage, health and event batches."""

from __future__ import annotations

from pyspark.sql import functions as F

from docpipe.operators import health as H
from docpipe.operators import inventory as I
from docpipe.operators import parts as R
from docpipe.operators import state as S
from docpipe.operators.order import numbered
from docpipe.plans.derived import ddb, view
from docpipe.streaming import events as E

c = F.col
QUERIES, SQL = {}, {}
LIST = lambda xs: ", ".join(f"'{x}'" for x in xs)
# Values are written out here, not taken from the functions that the SQL checks.
GROUP = "case when status in ('waiting_stable','queued','waiting_mineru') then 'pending' when status in ('converting','waiting_parts','uploading','processing','downloading') then 'active' else status end"
VISIBLE = """n as (select parent_task_id, count(*) as n_parts from parts group by 1), vis as (select 'task' as kind, id, null::bigint as part_index, profile_id, status, updated_at, coalesce(n_parts, 0) as n_parts from tasks left join n on id=parent_task_id
 union all select 'part', t.id, part_index, t.profile_id, p.status, p.updated_at, 0 from parts p join tasks t on p.parent_task_id=t.id)"""


def query(name, sql=None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("visible_tasks", ddb("tasks parts", f"with {VISIBLE} select kind, id, coalesce(part_index, 0) as part_index, profile_id, status, updated_at, n_parts from vis order by updated_at desc, kind, id, part_index limit 5000"))
def visible_tasks(s, d):
    """The 5,000 newest rows of tasks and parts: the dashboard's feature."""
    out = S.visible(view(s, d, "tasks"), view(s, d, "parts")).withColumn("part_index", F.coalesce("part_index", F.lit(0)))
    return S.newest(out, 5000, "kind", "id", "part_index")


@query("recent_tasks", ddb("tasks", "select * from tasks order by updated_at desc, id limit 1000"))
def recent_tasks(s, d):
    return S.newest(view(s, d, "tasks"), 1000, "id")


@query("task_search", ddb("tasks", "select id, profile_id, engine, status from tasks where contains(lower(concat_ws(' ', profile_id, engine, status)), 'p3 copy f')"))
def task_search(s, d):
    return H.searched(view(s, d, "tasks"), " P3 Copy F ", "profile_id", "engine", "status").select("id", "profile_id", "engine", "status")


@query("task_tag_status", ddb("tasks tag_jobs", "select coalesce(j.status, 'none') as tag_status, t.status, count(*) as n from tasks t left join tag_jobs j using (id) group by all"))
def task_tag_status(s, d):
    jobs = view(s, d, "tag_jobs").select("id", c("status").alias("tag_status"))
    return view(s, d, "tasks").join(jobs, "id", "left").groupBy(F.coalesce("tag_status", F.lit("none")).alias("tag_status"), "status").agg(F.count("*").alias("n"))


@query("status_counts", ddb("tasks parts", f"with a as (select status from tasks union all select status from parts), g as (select {GROUP} as status_group, count(*) as n from a group by 1) select status_group, coalesce(n, 0) as n from (select unnest(['pending','active','completed','failed']) as status_group) left join g using (status_group)"))
def status_counts(s, d):
    return S.status_counts(view(s, d, "tasks").select("status").unionAll(view(s, d, "parts").select("status")))


@query("queue_order", ddb("tasks requests", "with r as (select path, max(strength) as strength from requests group by 1) select id, coalesce(strength, -1)::int as strength, row_number() over (partition by profile_id order by strength desc nulls last, updated_at, id)::int as place from tasks left join r on path=id where status='queued'"))
def queue_order(s, d):
    """The backlog of each profile: asked-for files first, the strongest request before others, then the oldest."""
    t = view(s, d, "tasks").where("status = 'queued'").join(E.coalesced(view(s, d, "requests")).withColumnRenamed("path", "id"), "id", "left")
    placed = numbered(t, ["profile_id"], [c("strength").isNull(), -c("strength"), c("updated_at"), c("id")])
    return placed.select("id", F.coalesce("strength", F.lit(-1)).alias("strength"), "place")


@query("retry_candidates", ddb("tasks parts", "with f as (select id, 0::bigint as part_index from tasks where status='failed' union all select parent_task_id, part_index from parts where status='failed') select * from f where id in (select id from tasks where engine<>'copy')"))
def retry_candidates(s, d):
    t = view(s, d, "tasks")
    return S.retry_candidates(t, view(s, d, "parts"), t.where("engine <> 'copy'")).withColumn("part_index", F.coalesce("part_index", F.lit(0)))


@query("recover_interrupted", ddb("tasks parts", "with a as (select 'task' as kind, status, false as b from tasks union all select 'part', case when part_index%3=0 then 'uploading' else status end, part_index%2=0 from parts) select kind, action, count(*) as n from (select kind, case when kind='task' and status='converting' then 'wait_for_parts' when kind='part' and status='uploading' then 'reset' when kind='part' and status='processing' then case when b then 'resume' else 'reset' end end as action from a) where action is not null group by all"))
def recover_interrupted(s, d):
    t = view(s, d, "tasks").select(F.lit("task").alias("kind"), "status", F.lit(False).alias("b"))
    p = view(s, d, "parts").select(F.lit("part").alias("kind"), F.when(c("part_index") % 3 == 0, "uploading").otherwise(c("status")).alias("status"), (c("part_index") % 2 == 0).alias("b"))
    return t.unionAll(p).select("kind", S.recovered(c("kind"), c("status"), c("b")).alias("action")).where("action is not null").groupBy("kind", "action").agg(F.count("*").alias("n"))


@query("remove_profile", ddb("tasks parts", "with t as (select * from tasks where profile_id not in ('p1','p4')) select profile_id, count(distinct id) as tasks, count(parent_task_id) as parts from t left join parts on id=parent_task_id group by 1"))
def remove_profile(s, d):
    t = view(s, d, "tasks")
    left = S.without_profile(t, t.select("profile_id").distinct().where("profile_id in ('p1', 'p4')"))
    n = view(s, d, "parts").groupBy("parent_task_id").agg(F.count("*").alias("n"))
    return left.join(n, c("id") == c("parent_task_id"), "left").groupBy("profile_id").agg(F.count("*").alias("tasks"), F.coalesce(F.sum("n"), F.lit(0)).alias("parts"))


@query("state_upsert", ddb("tasks", "with o as (select id, profile_id, status, 'e'||id as error, updated_at as created_at from tasks where id%3<>0), w as (select id, 'p9' as profile_id, 'queued' as status from tasks where id%2=0) select coalesce(o.id, w.id) as id, coalesce(w.profile_id, o.profile_id) as profile_id, coalesce(w.status, o.status) as status, case when w.id is null then error end as error, coalesce(o.created_at, timestamp '2024-01-01') as created_at from o full join w on o.id=w.id"))
def state_upsert(s, d):
    t = view(s, d, "tasks")
    old = t.where("id % 3 <> 0").select("id", "profile_id", "status", F.concat(F.lit("e"), c("id").cast("string")).alias("error"), c("updated_at").alias("created_at"))
    new = t.where("id % 2 = 0").select("id", F.lit("p9").alias("profile_id"), F.lit("queued").alias("status"), F.lit(None).cast("string").alias("error"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("created_at"))
    return S.upserted(old, new, "id", kept=["created_at"], cleared=["error"])


SUMMARY = """su as (select parent_task_id, count(*) as total, count(*) filter (status='completed') as completed, count(*) filter (status='failed') as failed, sum(case when status='completed' then pages else 0 end)::bigint as extracted_pages, bool_and(status='completed' and artifact_ready) as ready from parts group by 1)"""


@query("part_summary", ddb("parts", f"with {SUMMARY} select *, case when failed>0 then 'failed' when completed=total then 'waiting_merge' else 'waiting_parts' end as status from su"))
def part_summary(s, d):
    return R.summary(view(s, d, "parts"))


@query("parts_ready", ddb("tasks parts", f"with {SUMMARY} select id from su join tasks on id=parent_task_id where ready and total>0 and id%4<>0"))
def parts_ready(s, d):
    """Parents whose parts are all there, and whose hash the parts still have (ids that 4 divides changed since)."""
    return R.summary(view(s, d, "parts")).where("ready").join(view(s, d, "tasks").where("id % 4 <> 0"), c("id") == c("parent_task_id")).select("id")


@query("part_progress", ddb("parts", f"with {SUMMARY} select parent_task_id, round(100.0*completed/total)::bigint as progress from su"))
def part_progress(s, d):
    return R.summary(view(s, d, "parts")).select("parent_task_id", R.progress(c("completed"), c("total")).alias("progress"))


@query("pdf_parts", ddb("tasks", "with p as (select id, id%1203 as pages from tasks where engine='mineru'), q as (select id, pages, (pages+199)//200 as part_count, unnest(range(1, (pages+199)//200+1)) as part_index from p) select id, part_index, part_count, (part_index-1)*200+1 as page_start, least(part_index*200, pages) as page_end, ((part_index-1)*200+1)||'-'||least(part_index*200, pages) as page_range from q"))
def pdf_parts(s, d):
    return R.page_ranges(view(s, d, "tasks").where("engine = 'mineru'").select("id", (c("id") % 1203).alias("pages")))


@query("multipart_merge", ddb("messages", "select doc_id, count(*) as n_parts, string_agg('<!-- part '||part_index||' -->'||chr(10)||chr(10)||coalesce(text, ''), chr(10)||chr(10) order by part_index) as markdown from messages group by 1"))
def multipart_merge(s, d):
    return R.merged(view(s, d, "messages")).drop("too_large")


@query("merged_pieces", ddb("messages", """with m as (select doc_id, string_agg('<!-- part '||part_index||' -->'||chr(10)||chr(10)||coalesce(text, ''), chr(10)||chr(10) order by part_index) as body from messages group by 1)
 select doc_id, k::int as piece, ((length(body)+199)//200)::int as pieces, substr(body, (k-1)*200+1, 200) as text from m, unnest(range(1, (length(body)+199)//200+1)) as t(k)"""))
def merged_pieces(s, d):
    """Merged documents in pieces of 200 characters."""
    return R.merged_pieces(view(s, d, "messages"), 200)


@query("ocr_verdict", ddb("parts", "with o as (select parent_task_id as doc_id, (part_index-1)*200 as o, pages%5=0 as need, pages, case when pages=49 then 'bad part '||part_index end as error from parts) select doc_id, bool_or(need) as needs_ocr, coalesce(array_to_string(list_sort(flatten(list(case when need then [o+1, o+pages] else [] end))), ','), '') as ocr_pages, coalesce(max(error), '') as error from o group by 1"))
def ocr_verdict(s, d):
    need = c("pages") % 5 == 0
    chunks = view(s, d, "parts").select(
        c("parent_task_id").alias("doc_id"), ((c("part_index") - 1) * 200).alias("offset"), need.alias("needs_ocr"), F.when(need, F.array(F.lit(1).cast("long"), c("pages"))).otherwise(F.array().cast("array<bigint>")).alias("pages"),
        F.when(c("pages") == 49, F.concat(F.lit("bad part "), c("part_index").cast("string"))).alias("error"),
    )
    return R.ocr_verdict(chunks).select("doc_id", "needs_ocr", F.array_join(F.transform("ocr_pages", lambda x: x.cast("string")), ",").alias("ocr_pages"), F.coalesce("error", F.lit("")).alias("error"))


@query("asset_budget", "with a as (select l_orderkey as doc_id, l_partkey as resource, max(l_quantity)::bigint*1000000 as bytes from lineitem group by 1, 2) select doc_id, sum(bytes)::bigint as bytes, sum(bytes) <= 134217728 as fits from a group by 1")
def asset_budget(s, d):
    a = view(s, d, "lineitem").select(c("l_orderkey").alias("doc_id"), c("l_partkey").alias("resource"), (c("l_quantity").cast("long") * 1000000).alias("bytes"))
    return H.asset_budget(a, 128 << 20)


@query("profile_diff", ddb("roots", "with o as (select id, root as rules from roots where length(id)<3), n as (select id, case when id like '%2' then root||'x' else root end as rules from roots where id not like 'r%' or id='r0') select coalesce(o.id, n.id) as id, case when n.id is null then 'removed' when o.id is null then 'added' else 'changed' end as change from o full join n on o.id=n.id where n.id is null or o.id is null or o.rules<>n.rules"))
def profile_diff(s, d):
    r = view(s, d, "roots")
    old = r.where("length(id) < 3").select("id", c("root").alias("rules"))
    new = r.where("id not like 'r%' or id = 'r0'").select("id", F.when(c("id").like("%2"), F.concat("root", F.lit("x"))).otherwise(c("root")).alias("rules"))
    return S.profile_diff(old, new)


@query("health_rollup", ddb("roots tasks", """with o as (select 1 from roots a join roots b on a.id<>b.id and (a.root=b.root or starts_with(b.root, a.root||'/'))), h as (select 'roots' as "check", case when count(*)>0 then 'ok' else 'warning' end as level, count(*) as n from roots
 union all select 'overlaps', case when count(*)>0 then 'error' else 'ok' end, count(*) from o union all select 'ocr', case when count(*)>0 then 'warning' else 'ok' end, count(*) from tasks where status='waiting_mineru' union all select 'failures', case when count(*)>0 then 'warning' else 'ok' end, count(*) from tasks where status='failed')
 select * from h union all select 'overall', max_by(level, list_position(['ok','warning','error'], level)), count(*) from h"""))
def health_rollup(s, d):
    r = view(s, d, "roots")
    rows = H.health(r, I.overlaps(r), view(s, d, "tasks"), ocr_ready=False)
    return rows.unionByName(H.worst(rows).select(F.lit("overall").alias("check"), "level", c("checks").alias("n")))


@query("health_profiles", ddb("roots", """with o as (select a.id as x, b.id as y from roots a join roots b on a.id<>b.id and (a.root=b.root or starts_with(b.root, a.root||'/'))), both_ as (select x as id from o union select y from o),
 p as (select id, id like '%1' as off, id like '%2' as gone, id like 'n%' as tagging, length(root)%5=0 as empty from roots) select id as profile_id, 'input' as "check", case when off then 'ok' when gone then 'error' else 'ok' end as level from p
 union all select id, 'overlap', case when id in (select id from both_) then 'error' else 'ok' end from p union all select id, 'model', case when not tagging then 'ok' when empty then 'error' else 'warning' end from p"""))
def health_profiles(s, d):
    """Checks of each watched root: some are off, some cannot be read, some classify without labels or a model."""
    r = view(s, d, "roots")
    p = r.select(c("id").alias("profile_id"), (~c("id").like("%1")).alias("enabled"), (~c("id").like("%2")).alias("available"), c("id").like("n%").alias("tagging"), (F.length("root") % 5).alias("labels"))
    return H.profile_health(p, I.overlaps(r), model_ready=False)


@query("reclassify", ddb("tag_jobs", "select status, schema_hash, case when status in ('completed','queued') then schema_hash<>'new' else status in ('failed','outdated') end as requeue, count(*) as n from tag_jobs group by all"))
def reclassify(s, d):
    j = view(s, d, "tag_jobs")
    return j.groupBy("status", "schema_hash", S.should_requeue(c("status"), c("schema_hash"), F.lit("new")).alias("requeue")).agg(F.count("*").alias("n"))


@query("tagging_impact", ddb("md_docs tag_jobs", "select count(*) as discovered, count(*) filter (j.id is null) as new, count(*) filter (j.id is null or schema_hash<>'new' or status<>'completed') as affected from md_docs left join tag_jobs j on j.id=doc_id"))
def tagging_impact(s, d):
    return H.rules_impact(view(s, d, "md_docs").select(c("doc_id").alias("path")), view(s, d, "tag_jobs").select(c("id").alias("path"), "schema_hash", "status"), "new")


@query("usage_totals", ddb("tag_jobs", "with u as (select profile_id, count(*) as jobs, sum(id%4+1)::bigint as calls, sum(read_bytes//4)::bigint as input_tokens, sum(id%97)::bigint as output_tokens, sum(read_bytes)::bigint as read_bytes, sum(total_bytes)::bigint as total_bytes from tag_jobs group by 1) select *, input_tokens+output_tokens as tokens, least(100, round(100.0*read_bytes/total_bytes))::bigint as coverage from u"))
def usage_totals(s, d):
    j = view(s, d, "tag_jobs").select("profile_id", (c("id") % 4 + 1).alias("calls"), F.expr("read_bytes div 4").alias("input_tokens"), (c("id") % 97).alias("output_tokens"), "read_bytes", "total_bytes")
    return H.usage(j)


@query("debounce_sessions", "with c as (select 'p'||(user_id%20) as profile_id, ts from events), m as (select *, case when ts >= lag(ts) over (partition by profile_id order by ts) + interval 600 second or lag(ts) over (partition by profile_id order by ts) is null then 1 else 0 end as f from c), g as (select *, sum(f) over (partition by profile_id order by ts rows unbounded preceding) as k from m) select profile_id, min(ts) as start, max(ts)+interval 600 second as \"end\", count(*) as changes from g group by profile_id, k")
def debounce_sessions(s, d):
    ch = view(s, d, "events").select(F.concat(F.lit("p"), (c("user_id") % 20).cast("string")).alias("profile_id"), c("ts").cast("timestamp").alias("ts"))
    return E.debounced(ch, "600 seconds").select("profile_id", c("start").cast("timestamp_ntz").alias("start"), c("end").cast("timestamp_ntz").alias("end"), "changes")


@query("coalesce_requests", ddb("requests", "select path, max(strength)::int as strength, count(*) as requests from requests group by 1"))
def coalesce_requests(s, d):
    return E.coalesced(view(s, d, "requests"))


@query("stable_files", "with o as (select 'f'||user_id as path, ts, (value*0+event_id%3//2)::bigint as size from events), a as (select *, row_number() over w as n, coalesce(size=lag(size) over w, false) as same from o window w as (partition by path order by ts, size)), b as (select *, same and coalesce(lag(same) over (partition by path order by n), false) as hit from a), f as (select path, min_by(ts, n) as ts, min_by(size, n) as size from b where hit and n<=60 group by 1) select path, ts, size, f.path is not null as stable from (select distinct path from o) left join f using (path)".replace("f.path is not null", "ts is not null"))
def stable_files(s, d):
    seen = view(s, d, "events").select(F.concat(F.lit("f"), c("user_id").cast("string")).alias("path"), "ts", F.expr("(event_id % 3) div 2").alias("size"))
    return E.stable_files(seen)
