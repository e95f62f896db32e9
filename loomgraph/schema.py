"""Node, edge, log and evaluation schemas, and the label maps of the property graph."""
from __future__ import annotations

# Schemas are DDL text: Spark takes it wherever a schema is asked for, and it needs no session.
STORY = ("story_id string, title string, description string, embedding array<double>, "
         "verified_spec string")
STEP = "step_id string, step_type string, text string, embedding array<double>"
DEFINITION = ("definition_id string, expression string, code_block string, "
              "embedding array<double>")
IMPLEMENTS = "story_id string, step_id string"
BINDS = "step_id string, definition_id string"
DEPENDS_ON = "story_id string, depends_on_story_id string"

# Node labels with their key column, edge labels with their (source, target) columns.
NODE_KEYS = {"UserStory": "story_id", "GherkinStep": "step_id", "RubyDefinition": "definition_id"}
NODE_SCHEMAS = {"UserStory": STORY, "GherkinStep": STEP, "RubyDefinition": DEFINITION}
EDGE_KEYS = {
    "IMPLEMENTS": ("story_id", "step_id"),
    "BINDS": ("step_id", "definition_id"),
    "DEPENDS_ON": ("story_id", "depends_on_story_id"),
}
EDGE_SCHEMAS = {"IMPLEMENTS": IMPLEMENTS, "BINDS": BINDS, "DEPENDS_ON": DEPENDS_ON}
# foreign keys: edge label -> (edge column, node label)
EDGE_REFS = {
    "IMPLEMENTS": (("story_id", "UserStory"), ("step_id", "GherkinStep")),
    "BINDS": (("step_id", "GherkinStep"), ("definition_id", "RubyDefinition")),
    "DEPENDS_ON": (("story_id", "UserStory"), ("depends_on_story_id", "UserStory")),
}


def node_key(label: str) -> str:
    if label not in NODE_KEYS:
        raise ValueError(f"Unknown node label: {label}")
    return NODE_KEYS[label]


def edge_key(label: str) -> tuple[str, str]:
    key = EDGE_KEYS.get(label.upper())
    if key is None:
        raise ValueError(f"Unknown edge label: {label}")
    return key


# Column names of the exported inference log.
LOG = """
    logName string, textPayload string, timestamp timestamp, receiveTimestamp timestamp,
    severity string, insertId string, trace string, spanId string, traceSampled boolean,
    resource struct<type: string, labels: struct<project_id: string, location: string>>,
    labels struct<
        gen_ai_conversation_id: string, gen_ai_agent_name: string,
        gen_ai_input_messages_ref: string, gen_ai_output_messages_ref: string,
        gen_ai_system_instructions_ref: string, gen_ai_usage_input_tokens: string,
        gen_ai_usage_output_tokens: string, gen_ai_response_finish_reasons: string,
        gen_ai_tool_definitions: string, gen_ai_tool_definitions_ref: string,
        gcp_vertex_agent_invocation_id: string, gcp_vertex_agent_event_id: string,
        event_name: string, user_id: string>
"""
COMPLETION = """
    parts array<struct<type: string, content: string, mime_type: string, uri: string,
        data: binary, id: string, name: string, arguments: string, response: string>>,
    role string, index bigint
"""
EVAL_CASE = """
    case_id string, component string, description string,
    input struct<agent_name: string, prompt: string, outputs: array<string>,
        original_story_embedding: array<double>, response_embedding: array<double>,
        step_type: string, step_text: string, existing_phrase: string>,
    expected struct<circuit_breaker_tripped: boolean, reason_contains: string,
        is_approved: boolean, reused: boolean, scaffolded: boolean>
"""
_CONTENT = "struct<role: string, parts: array<struct<text: string>>>"
EVAL_DATASET = f"""
    eval_cases array<struct<
        eval_case_id: string, prompt: {_CONTENT},
        agent_data: struct<turns: array<struct<turn_index: bigint,
            events: array<struct<author: string, content: {_CONTENT}>>>>>,
        reference: struct<response: {_CONTENT}>>>
"""
ACTION = ("run_id bigint, seq bigint, agent_name string, prompt string, response string, "
          "timestamp timestamp, story_vec array<double>, response_vec array<double>")
