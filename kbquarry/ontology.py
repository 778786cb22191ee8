"""Small dimension data and word lists of the knowledge base: fixed values, in natural order."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# Entity types and their layers.
TYPE_LAYERS = {
    "system": "structural", "software-component": "structural", "api": "structural", "data-model": "structural", "data-product": "structural", "platform": "structural",
    "process": "behavioral", "business-event": "behavioral", "domain-logic": "behavioral", "reference-data": "reference",
    "team": "organizational", "persona": "organizational", "capability": "organizational", "offering": "organizational", "external-party": "organizational",
    "jargon-business": "language", "jargon-tech": "language", "decision": "decision",
}
TYPES = list(TYPE_LAYERS)
LAYERS = ["structural", "behavioral", "reference", "organizational", "language", "decision"]
# Front matter keys that name relationships.
RELATION_KEYS = [
    "related_to", "depends_on", "owned_by", "deployed_on", "implements_capability", "consumes", "produces", "triggers", "triggered_by", "affects",
    "affected_by", "related_systems", "related_processes", "triggered", "published_by", "subscribed_by", "managed_by",
]
STATUSES = ["active", "deprecated", "planned", "proposed"]
# Expected relationships (type, relationship, target type) used by the audit of the adapters' graph.
EXPECTED = [("order", "owned_by", "customer"), ("order", "contains", "part"), ("part", "produced_by", "supplier"), ("customer", "belongs_to", "nation"), ("supplier", "belongs_to", "nation"), ("nation", "part_of", "region"), ("part", "owned_by", "customer")]
# Words that don't count in entity names, in questions and as keywords.
NAME_STOPS = "the a an and or for of to in is on at by".split()
QUESTION_STOPS = "what how does the is are and or for in of to a an this that it be can do from with which when where who why should would could about between through during specific currently each".split()
KEYWORD_STOPS = (
    "the a an is are was were do does did how what who when where why which that this it to for of in on at by with and or but not from about all can will be has have had "
    "i my me we our you your tell show list give want know need"
).split()
# Intents and the patterns that speak for them.
INTENTS = {
    "entity": [r"\bwhat is\b", r"\bdefine\b", r"\bexplain\b", r"\bdescribe\b", r"\btell me about\b"],
    "process": [r"\bhow does\b", r"\bhow do\b", r"\bwhat happens\b", r"\bwhat occurs\b", r"\bworkflow\b", r"\bflow\b", r"\bsteps?\b", r"\bpipeline\b", r"\bprocess\b", r"\bsequence\b"],
    "relationship": [r"\bconnects?\b", r"\bdepends?\b", r"\brelat", r"\bintegrat", r"\binteract"],
    "ownership": [r"\bwho owns\b", r"\bresponsib", r"\bteam\b", r"\bowner\b", r"\bmanages?\b", r"\bmanaged by\b"],
    "temporal": [r"\bwhen did\b", r"\bwhen was\b", r"\bwhen does\b", r"\bchanged\b", r"\bhistory\b", r"\bbefore\b", r"\bafter\b", r"\bsince when\b"],
    "diagnostic": [r"\bwhat.s missing\b", r"\bgap\b", r"\bincomplete\b", r"\bwhat.*don.t know\b"],
    "listing": [r"\blist all\b", r"\bshow all\b", r"\bhow many\b", r"\ball the\b", r"\bevery\b"],
    "comparison": [r"\bsimilar\b", r"\bcompare\b", r"\bdifference\b", r"\bvs\b", r"\bversus\b"],
}
# What an intent adds to layers, and the edges that it follows (others: all).
INTENT_LAYERS = {"entity": {"structural": 1.5, "language": 1.3}, "process": {"behavioral": 1.5, "structural": 1.2}, "ownership": {"organizational": 1.5}, "temporal": {"decision": 1.3}}
INTENT_EDGES = {"process": ["triggers", "handles", "produces", "consumes", "executed_by", "routes_to"], "ownership": ["owned_by", "belongs_to", "managed_by", "executed_by"]}


def layer_of(entity_type: Column) -> Column:
    """The layer of a type, unknown for others; eighteen branches, no join."""
    out = F.lit("unknown")
    for t, layer in TYPE_LAYERS.items():
        out = F.when(entity_type == t, layer).otherwise(out)
    return out
