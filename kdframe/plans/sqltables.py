"""The derived tables of ``tables`` once more as plain SQL, for the independent check."""

from __future__ import annotations

import re

from kdframe.operators.eval_prompts import registry_rows
from kdframe.operators.tokens import TOKENISERS

_NEIGHBOURS = """
SELECT a.vec_id, a.label, list_transform(a.embedding, lambda x: x::DOUBLE) AS v,
       list_transform(b.embedding, lambda x: x::DOUBLE) AS w
FROM embeddings a JOIN embeddings b
  ON b.vec_id = (a.vec_id + 1) % (SELECT max(vec_id) + 1 FROM embeddings)
"""


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, list):
        return "[" + ", ".join(map(_literal, value)) + "]::VARCHAR[]"
    return str(value) if isinstance(value, int) else f"'{value}'"


def _registry() -> str:
    """The task registry, numbered from 0."""
    names = "task, prompt, subset, metric, generation_size, stops, few_shot_split, few_shot_select, evaluation_splits".split(", ")
    columns = ", ".join(f"unnest([{', '.join(_literal(row[i]) for row in registry_rows())}]) AS {name}" for i, name in enumerate(names))
    return f"SELECT unnest(range({len(registry_rows())})) AS number, {columns}"


def _hidden(column: str, layers: int, masked: int) -> str:
    return f"""
SELECT vec_id // {5 * layers} AS seq_id, (vec_id // 5 % {layers})::INT AS layer, (vec_id % 5)::INT AS pos,
       {column} AS h, (vec_id % {masked} <> 0)::INT AS mask
FROM neighbours"""


def _tokens(source: str, keys: str, text: str, tokeniser: str) -> str:
    pieces = f"regexp_extract_all({text}, '{TOKENISERS[tokeniser]}')"
    return f"""
SELECT {keys}, unnest({pieces}) AS piece, generate_subscripts({pieces}, 1) - 1 AS nth FROM {source}"""


def _vocabulary(source: str) -> str:
    return f"""
SELECT piece, n,
       CASE piece WHEN '<|endoftext|>' THEN 0 WHEN '<|im_start|>' THEN 1 WHEN '<|im_end|>' THEN 2
            ELSE row_number() OVER (PARTITION BY piece IN ('<|endoftext|>', '<|im_start|>', '<|im_end|>')
                                    ORDER BY n DESC, piece) + 2 END AS id
FROM (SELECT piece, count(*) AS n FROM {source} GROUP BY piece)"""


TABLES = {
    "lines": """
SELECT doc_id, source, line, i - 1 AS i FROM (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)""",
    "said": """
SELECT doc_id, source, i,
       CASE WHEN (doc_id + i) % 11 = 10 THEN 'system' WHEN (doc_id + i) % 13 = 12 THEN 'tool'
            WHEN i % 2 = 0 THEN 'human' ELSE 'gpt' END AS speaker,
       CASE WHEN (doc_id + i) % 9 = 8 THEN NULL ELSE line END AS value
FROM lines""",
    "spoken_roles": """
SELECT doc_id, source, i, CASE speaker WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE speaker END AS role,
       coalesce(value, '') AS content
FROM said""",
    "alpaca": """
SELECT doc_id, source, CASE WHEN doc_id % 17 <> 16 THEN 'Summarise source ' || source END AS instruction,
       CASE WHEN doc_id % 2 = 0 THEN text ELSE '' END AS input, CASE WHEN doc_id % 5 <> 4 THEN lang END AS output
FROM documents""",
    "registry": _registry(),
    "suite_items": f"""
SELECT doc_id AS item_id, task, prompt, ['test', 'validation', 'train', 'fewshot', 'train'][doc_id // {len(registry_rows())} % 5 + 1] AS split,
       text AS input, 'answer ' || n_chars AS target, lang, source, n_chars
FROM documents JOIN registry ON number = doc_id % {len(registry_rows())}""",
    "qa": """
SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1
WHERE a.role = 'user' AND b.role = 'assistant'""",
    "preferences": """
SELECT q.conv_id, q.turn, coalesce(s.text, '') AS system, q.question, q.answer AS chosen,
       array_to_string(list_reverse(string_split(q.answer, ' ')), ' ') AS rejected
FROM qa q LEFT JOIN conversations s ON s.conv_id = q.conv_id AND s.turn = 0 AND s.role = 'system'""",
    "fragments": r"""
SELECT conv_id, place, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS fragment FROM (
  SELECT conv_id, CASE WHEN role = 'system' THEN -1 - turn ELSE turn END AS place, role, text FROM conversations
  UNION ALL
  SELECT conv_id, -1, 'system', 'You are a helpful assistant.' FROM conversations
  GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0)
UNION ALL
SELECT conv_id, max(CASE WHEN role = 'system' THEN -1 - turn ELSE turn END) + 1, '<|im_start|>assistant' || chr(10)
FROM conversations GROUP BY conv_id""",
    "student_raw": _tokens("fragments", "conv_id, place", "fragment", "student"),
    "teacher_raw": _tokens("fragments", "conv_id, place", "fragment", "teacher"),
    "student_all": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, nth) - 1 AS pos, piece FROM student_raw""",
    "teacher_all": """
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY place, nth) - 1 AS pos, piece FROM teacher_raw""",
    "student_vocabulary": _vocabulary("student_raw"),
    "teacher_vocabulary": _vocabulary("teacher_raw"),
    "encoded": """
SELECT s.conv_id, s.ids AS input_ids, t.ids AS teacher_input_ids FROM
 (SELECT conv_id, list(id::INT ORDER BY pos) AS ids FROM student_all JOIN student_vocabulary USING (piece)
  WHERE pos < 512 GROUP BY conv_id) s
 JOIN (SELECT conv_id, list(id::INT ORDER BY pos) AS ids FROM teacher_all JOIN teacher_vocabulary USING (piece)
  WHERE pos < 512 GROUP BY conv_id) t USING (conv_id)""",
    "encoded_whole": """
SELECT s.conv_id, s.ids AS input_ids, t.ids AS teacher_input_ids FROM
 (SELECT conv_id, list(id::INT ORDER BY pos) AS ids FROM student_all JOIN student_vocabulary USING (piece) GROUP BY conv_id) s
 JOIN (SELECT conv_id, list(id::INT ORDER BY pos) AS ids FROM teacher_all JOIN teacher_vocabulary USING (piece)
  GROUP BY conv_id) t USING (conv_id)""",
    "marked": """
SELECT conv_id, pos, piece, max(start_at) OVER w AS start_at, max(end_at) OVER w AS end_at FROM (
  SELECT conv_id, pos, piece,
         CASE WHEN lag(piece, 3) OVER o = '<|im_start|>' AND lag(piece, 2) OVER o = 'assistant'
                   AND lag(piece, 1) OVER o = chr(10) THEN pos END AS start_at,
         CASE WHEN piece = '<|im_end|>' THEN pos END AS end_at
  FROM student_all WHERE pos < 512 WINDOW o AS (PARTITION BY conv_id ORDER BY pos))
WINDOW w AS (PARTITION BY conv_id ORDER BY pos)""",
    "supervised": """
SELECT conv_id, pos, piece, coalesce(start_at > coalesce(end_at, -1), false) AS supervised FROM marked""",
    "conv_batches": """
SELECT conv_id, (row_number() OVER (ORDER BY md5('42:' || conv_id), conv_id) - 1) AS place FROM
 (SELECT DISTINCT conv_id FROM conversations)""",
    # preference pairs as token lists
    "pref_text": """
SELECT conv_id, turn,
       CASE WHEN length(system) > 0 THEN '<|im_start|>system' || chr(10) || system || '<|im_end|>' || chr(10) ELSE '' END
       || '<|im_start|>system' || chr(10) || 'You are a helpful assistant.<|im_end|>' || chr(10)
       || '<|im_start|>user' || chr(10) || question || '<|im_end|>' || chr(10) || '<|im_start|>assistant' || chr(10) AS prompt,
       chosen || '<|im_end|>n' AS chosen, rejected || '<|im_end|>n' AS rejected
FROM preferences""",
    "pref_rows": """
SELECT conv_id, turn, side, (row_number() OVER (PARTITION BY side ORDER BY md5('42:' || conv_id || ':' || turn), conv_id, turn) - 1) // 4 AS batch_id,
       prompt, completion
FROM (SELECT conv_id, turn, 'chosen' AS side, prompt, chosen AS completion FROM pref_text
      UNION ALL SELECT conv_id, turn, 'rejected', prompt, rejected FROM pref_text)""",
    "pref_tokens": _tokens("pref_rows", "conv_id, turn, side, batch_id, 0 AS part", "prompt", "student")
    + " UNION ALL "
    + _tokens("pref_rows", "conv_id, turn, side, batch_id, 1 AS part", "completion", "student"),
    "pref_vocabulary": _vocabulary("pref_tokens"),
    "pref_ids": """
SELECT conv_id, turn, side, batch_id,
       list(id::INT ORDER BY nth) FILTER (WHERE part = 0) AS p, list(id::INT ORDER BY nth) FILTER (WHERE part = 1) AS c
FROM pref_tokens JOIN pref_vocabulary USING (piece) GROUP BY ALL""",
    "pref_padded": """
SELECT *, max(len(p)) OVER (PARTITION BY batch_id) AS pw, max(len(c)) OVER (PARTITION BY batch_id) AS cw,
       max(len(p) + len(c)) OVER (PARTITION BY batch_id) AS tw,
       row_number() OVER (PARTITION BY batch_id ORDER BY side, conv_id, turn) - 1 AS row_no
FROM pref_ids""",
    "pref_flushed": """
SELECT batch_id, row_no, conv_id, turn, side, len(p) AS np, len(c) AS nc, tw,
       p || c || list_transform(range(tw - len(p) - len(c)), lambda x: 0) AS ids
FROM pref_padded""",
    "pref_cells": """
SELECT batch_id, row_no, np, nc, tw, unnest(ids) AS id, generate_subscripts(ids, 1) - 1 AS pos FROM pref_flushed""",
    # logits
    "neighbours": _NEIGHBOURS,
    "logits": """
SELECT vec_id // 5 AS seq_id, (vec_id % 5)::INT AS pos, v AS teacher, w[1:60] AS student, label,
       (vec_id % 5 > 0 AND vec_id % 5 < 4)::INT AS loss_mask, vec_id // 10 AS pair_id,
       CASE WHEN vec_id // 5 % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side, vec_id // 40 AS batch_id,
       CASE WHEN vec_id // 40 % 4 = 3 THEN 'eval' ELSE 'train' END AS split
FROM neighbours""",
    "aligned": """
SELECT * EXCLUDE (student), student || list_transform(range(4), lambda x: 0.0::DOUBLE) AS student FROM logits""",
    "logz": """
SELECT *, list_max(student) + ln(list_sum(list_transform(student, lambda x: exp(x - list_max(student))))) AS sz,
       list_max(teacher) + ln(list_sum(list_transform(teacher, lambda x: exp(x - list_max(teacher))))) AS tz
FROM aligned""",
    "logz2": """
SELECT *, ln(list_sum(list_transform(student, lambda x: exp(x / 2)))) AS sz2,
       ln(list_sum(list_transform(teacher, lambda x: exp(x / 2)))) AS tz2 FROM aligned""",
    "token_scores": """
SELECT *, CASE WHEN loss_mask = 1 THEN label ELSE 0 END AS label_or_zero,
       CASE WHEN loss_mask = 1 THEN student[label + 1] - sz ELSE 0 END AS logp,
       CASE WHEN loss_mask = 1 THEN teacher[label + 1] - tz ELSE 0 END AS ref_logp
FROM logz""",
    "kl_tokens": """
SELECT seq_id, batch_id, list_sum(list_transform(range(1, 65), lambda i: exp(teacher[i] - tz) * ((teacher[i] - tz) - (student[i] - sz)))) AS kl
FROM logz""",
    "pairs": """
SELECT pair_id, batch_id, split, sum(logp) FILTER (WHERE side = 'chosen') AS chosen,
       sum(logp) FILTER (WHERE side = 'rejected') AS rejected,
       sum(ref_logp) FILTER (WHERE side = 'chosen') AS ref_chosen,
       sum(ref_logp) FILTER (WHERE side = 'rejected') AS ref_rejected
FROM token_scores GROUP BY ALL""",
    "rewards": """
SELECT *, 0.1 * (chosen - ref_chosen) AS reward_chosen, 0.1 * (rejected - ref_rejected) AS reward_rejected,
       ln(1 + exp(-(0.1 * (chosen - ref_chosen) - 0.1 * (rejected - ref_rejected)))) AS loss
FROM pairs""",
    "weights": """
SELECT pair_id, least(exp(sum(w)), 1.0) AS policy_weight FROM (
  SELECT pair_id, side, sum((rolled - adj) * loss_mask) / sum(loss_mask) AS w FROM (
    SELECT pair_id, side, loss_mask,
           coalesce(lag(logp) OVER (PARTITION BY seq_id ORDER BY pos), last_value(logp) OVER (PARTITION BY seq_id ORDER BY pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS rolled,
           ln(list_sum(list_transform(student, lambda x: exp(2 * (x - sz))))) AS adj
    FROM token_scores) GROUP BY ALL) GROUP BY ALL""",
    "batch_kd": """
SELECT batch_id, sum(kl) / count(DISTINCT seq_id) AS kd FROM kl_tokens GROUP BY batch_id""",
    "batch_nll": """
SELECT batch_id, avg(sz - student[label_or_zero + 1]) AS nll FROM token_scores
WHERE side = 'chosen' AND label_or_zero <> 0 GROUP BY batch_id""",
    # hidden states
    "hidden_student": _hidden("w", 4, 7),
    "hidden_teacher": _hidden("v", 6, 6),
    "projected": """
SELECT seq_id, layer, pos, mask, list_transform(range(64), lambda o:
         list_sum(list_transform(range(64), lambda j: h[j + 1] * (((layer + o + j) % 7 - 3) / 64.0))) + o * 0.01) AS s
FROM hidden_student""",
    "mapped_pairs": """
SELECT s.seq_id, s.layer, s.pos, s.s, s.mask AS s_mask, t.h AS t, t.mask AS t_mask
FROM projected s JOIN hidden_teacher t ON t.seq_id = s.seq_id AND t.pos = s.pos
 AND t.layer = CASE s.layer WHEN 0 THEN 0 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 5 END""",
    "last_pairs": """
SELECT s.seq_id, s.layer - 2 AS layer, s.pos, list_transform(range(64), lambda o:
         list_sum(list_transform(range(64), lambda j: s.h[j + 1] * (((s.layer - 1 + o + j) % 7 - 3) / 64.0))) + o * 0.01) AS s, s.mask AS s_mask, t.h AS t, t.mask AS t_mask
FROM hidden_student s JOIN hidden_teacher t ON t.seq_id = s.seq_id AND t.pos = s.pos AND t.layer - 4 = s.layer - 2
WHERE s.layer > 1 AND t.layer > 3""",
    "errors": """
SELECT seq_id, layer, pos, s_mask * t_mask AS m,
       list_sum(list_transform(range(1, 65), lambda i: (s[i] - t[i]) * (s[i] - t[i]))) AS sq,
       list_sum(list_transform(range(1, 65), lambda i: CASE WHEN abs(s[i] - t[i]) <= 1 THEN 0.5 * (s[i] - t[i]) ** 2
                               ELSE abs(s[i] - t[i]) - 0.5 END)) AS hu,
       list_cosine_similarity(s, t) AS cos
FROM mapped_pairs""",
    "pooled": """
SELECT seq_id, layer, d, sum(s[d] * s_mask) / greatest(sum(s_mask), 1) AS s, sum(t[d] * t_mask) / greatest(sum(t_mask), 1) AS t
FROM mapped_pairs CROSS JOIN (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL""",
    "pooled_loss": """
SELECT layer, avg(1 - c) AS loss FROM (
  SELECT seq_id, layer, sum(s * t) / (sqrt(sum(s * s)) * sqrt(sum(t * t))) AS c FROM pooled GROUP BY ALL) GROUP BY layer""",
    "trainlog": """
SELECT event_id AS step, CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_id % 89 = 0 THEN 'nan'::DOUBLE ELSE value END AS loss_xe,
       value / 10 AS loss_kd, CASE WHEN event_id % 300 <> 0 THEN least(0.7::DOUBLE, 0.7::DOUBLE * event_id / 1000) END AS alpha, ts
FROM events""",
    # evaluation
    "choices": """
SELECT vec_id AS item_id, list_transform(embedding[1:4], lambda x: x::DOUBLE) AS logps,
       list_transform([' yes', ' no way', 'perhaps', 'a'], lambda w: repeat(w, label % 3 + 1)) AS choices, label % 4 AS gold
FROM embeddings""",
    "items": """
SELECT doc_id AS item_id, CASE doc_id % 3 WHEN 0 THEN 'bbh' WHEN 1 THEN 'math' ELSE 'arc' END AS task, source AS subset,
       text AS input, lang || ' ' || n_chars AS target,
       CASE WHEN doc_id % 10 < 2 THEN 'validation' WHEN doc_id % 10 < 4 THEN 'test' ELSE 'train' END AS split, lang, n_chars
FROM documents""",
    "runs": """
SELECT event_type AS model, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1 AS prompt_idx,
       'prompt ' || (row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) - 1) AS prompt,
       'answer ' || event_id AS response, value AS generation_time,
       json_extract_string(props, '$.k')::BIGINT AS tokens_generated
FROM events""",
    "speeds": """
SELECT *, CASE WHEN generation_time > 0 THEN tokens_generated / generation_time ELSE 0 END AS tokens_per_second FROM runs""",
    "stats": """
SELECT model, count(*) AS responses, avg(generation_time) AS avg_generation_time, avg(tokens_generated) AS avg_tokens_generated,
       CASE WHEN sum(generation_time) > 0 THEN sum(tokens_generated) / sum(generation_time) ELSE 0 END AS avg_tokens_per_second
FROM runs GROUP BY model""",
    "models": """
SELECT event_type AS model, row_number() OVER (ORDER BY min(struct_pack(ts := ts, id := event_id))) - 1 AS position,
       'models/' || event_type AS model_path, (sum(user_id) * 1000)::BIGINT AS total_params,
       sum(user_id) * 2000 / 1073741824::DOUBLE AS model_size_gb
FROM events GROUP BY event_type""",
    "task_reports": """
SELECT doc_id % 16 AS task_id, max_by(doc_id, doc_id) AS last, max_by(quality, doc_id) AS quality FROM labels GROUP BY doc_id % 16""",
    "status": """
SELECT user_id % 16 AS task_id, ts, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'done' ELSE 'running' END AS status,
       value AS score
FROM events""",
    "latest": """
SELECT task_id, ts, status, score FROM (
  SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY ts DESC) AS k FROM status) WHERE k = 1""",
    "words": """
SELECT doc_id AS request_id, unnest(string_split(text, ' ')) AS word, generate_subscripts(string_split(text, ' '), 1) - 1 AS seq
FROM documents""",
    "chunks": """
SELECT request_id, seq, CASE WHEN seq = 30 AND request_id % 4 = 0 THEN '<|endoftext|>' WHEN seq = 0 THEN word
            WHEN word = '' THEN '' ELSE ' ' || word END AS delta
FROM words""",
    "kept": """
SELECT * FROM chunks WHERE delta <> '' AND NOT (request_id % 4 = 0 AND seq >= 30)""",
    "emitted": """
SELECT doc_id AS request_id, k AS seq,
       CASE k WHEN 0 THEN substring(text, 1, length(text) // 2)
         WHEN 1 THEN CASE WHEN doc_id % 2 = 0 THEN 'so' ELSE substring(text, 1, 2) END WHEN 2 THEN text ELSE
         CASE doc_id % 3 WHEN 0 THEN text || ' end' WHEN 1 THEN text ELSE 'again ' || text END END AS text
FROM documents CROSS JOIN (SELECT unnest(range(4)) AS k)""",
    "sessions": """
SELECT conv_id AS chat_id, turn, role, text AS content,
       TIMESTAMP '2024-01-01 00:00:00' + to_minutes(turn + conv_id % 1000) AS ts
FROM conversations""",
    "agent_out": """
SELECT doc_id, text || CASE doc_id % 7
  WHEN 0 THEN '<tool_call>[{"name": "get_weather", "arguments": {"city": "Oslo"}}]</tool_call>'
  WHEN 1 THEN '<tool_call>[{"name": "get_current_time", "arguments": {}},' || chr(10) || '{"name": "fly", "arguments": {"to": "7"}}]</tool_call>'
  WHEN 2 THEN '<tool_call>[{"name": "open_webbrowser"</tool_call>'
  WHEN 3 THEN '<tool_call>[]</tool_call>'
  WHEN 4 THEN '<tool_call>[{"name": "fly", "arguments": {"to": "8"}}]</tool_call> and <tool_call>[]</tool_call>'
  WHEN 5 THEN '<tool_call>{"name": "get_weather"}</tool_call>' ELSE '' END AS text
FROM documents""",
    "rewrites": """
SELECT item_id, text AS source, text AS reference, array_to_string(kept[len(kept) // 2 + 1:] || kept[1:len(kept) // 2], ' ') AS output
FROM (SELECT *, list_filter(string_split(text, ' '), lambda w, i: i % 3 <> 0) AS kept FROM benchmark)""",
    "reports": """
SELECT doc_id, toxic, CASE doc_id % 8
  WHEN 0 THEN '{"results": {"a": {"acc": ' || quality || '.' || doc_id % 10 || '}, "b": {"accuracy": 9}}}'
  WHEN 1 THEN '{"results": {"a": {"score": 3, "accuracy": ' || quality || '.' || doc_id % 10 || '}}}'
  WHEN 2 THEN '{"results": {"a": {"metrics": {"em": ' || quality || '.' || doc_id % 10 || ', "score": 7}}}}'
  WHEN 3 THEN '{"results": {"a": {"acc": "text", "pass@1": ' || quality || '.' || doc_id % 10 || '}}}'
  WHEN 4 THEN '{"results": {"a": {"acc": ' WHEN 5 THEN '{"results": {}}' WHEN 6 THEN '{"other": 1}' END AS report
FROM labels""",
}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(m for m in re.findall(r"(?:FROM|JOIN)\s+\(?\s*(\w+)", text) if m in TABLES))


def with_tables(body: str) -> str:
    """``body`` preceded by the derived tables it uses, in order of need."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name in ordered:
            return
        for other in _needs(TABLES[name]):
            visit(other)
        ordered.append(name)

    for name in _needs(body):
        visit(name)
    if not ordered:
        return body.strip()
    ctes = ",\n".join(f"{name} AS ({TABLES[name].strip()})" for name in ordered)
    body = body.strip()
    if body.startswith("WITH "):
        return f"WITH {ctes},\n{body.removeprefix('WITH ')}"
    return f"WITH {ctes}\n{body}"
