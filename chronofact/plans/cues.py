"""Fixed values of query understanding: cue words, rules and tables, in the order in which they are tried."""

COLLECTION = ("which videos", "across videos", "across all", "every video", "all videos", "both videos", "in which video")
COMPARISON = ("compare", "difference", "differ", " vs ", "versus", "regression", "old vs", "before vs", "before/after")
SUMMARY = ("summarize", "summary", "overview of", "tldr", "tl;dr", "recap")
SEQUENCE = ("sequence", "in order", "step by step", "what happened next", "then what", "chain of events")
EVIDENCE = ("show me the evidence", "prove it", "evidence for", "cite", "source of")
CHANGE = ("what changed", "changed after", "changed between", "difference between", "transition", "became visible", "stopped appearing")
TIMELINE = ("timeline of", "timeline for", "occurrences of", "every time", "all mentions", "all occurrences", "when did")
SCREEN = ("screen", "login page", "button", "state of", "visible on screen", "ui ", "interface", "modal", "homepage", "dashboard")
MODALITIES = {
    "transcript": ("said", "saying", "spoken", "quote", "mention", "tell me", "hear"),
    "ocr": ("shown", "visible", "screen", "written", "display", "slide", "text"),
    "vision": ("look like", "appearance", "color", "layout", "animation", "show"),
    "events": ("happen", "event", "click", "navigate", "error", "change"),
}
#: Modalities that can answer an intent, where the question names none.
INTENT_MODALITIES = {
    "change_detection": ("ocr", "transcript", "scenes"),
    "event_sequence": ("events",),
    "ui_state_query": ("ocr",),
}
#: The steps that answer an intent.
STRATEGIES = {
    "fact_lookup": ("lexical retrieval", "co-occurrence boost", "rank and select"),
    "temporal_before": ("resolve anchor entity", "locate anchor range", "retrieve preceding facts", "rank by recency", "apply budget"),
    "temporal_after": ("resolve anchor entity", "locate anchor range", "retrieve subsequent facts", "expand neighborhood", "rank by recency", "apply budget"),
    "temporal_between": ("resolve both anchors", "constrain to range", "retrieve within range", "apply budget"),
    "temporal_while": ("retrieve anchor matches", "expand co-occurring neighborhood", "apply budget"),
    "first_occurrence": ("retrieve anchor matches", "return earliest span"),
    "last_occurrence": ("retrieve anchor matches", "return latest span"),
    "change_detection": ("detect adjacent-region turnover", "attach before/after evidence", "apply budget"),
    "entity_timeline": ("resolve entity", "list all occurrences in time order", "attach surrounding context"),
    "event_sequence": ("order events by timestamp", "split on large gaps"),
    "co_occurrence": ("retrieve anchor matches", "expand neighborhood", "keep co-occurring modalities"),
    "comparison": ("extract entities per video", "diff occurrences and events"),
    "multi_video_search": ("search each video", "merge by score", "preserve video provenance"),
    "cross_video_comparison": ("link entities across videos", "diff per-video evidence"),
    "ui_state_query": ("list stable UI states", "match overlapping states"),
    "evidence_request": ("retrieve anchor matches", "return with references"),
    "general_summary": ("chapter overview", "global context", "key evidence"),
}
#: Operations on the evidence graph for an intent.
GRAPH_OPERATIONS = {
    "temporal_before": ("temporal_neighbors", "supporting_evidence"),
    "temporal_after": ("temporal_neighbors", "supporting_evidence"),
    "temporal_between": ("supporting_evidence",),
    "temporal_while": ("temporal_neighbors",),
    "entity_timeline": ("entity_occurrences", "supporting_evidence"),
    "first_occurrence": ("entity_occurrences",),
    "last_occurrence": ("entity_occurrences",),
    "event_sequence": ("temporal_neighbors",),
    "co_occurrence": ("temporal_neighbors",),
    "evidence_request": ("supporting_evidence",),
    "change_detection": ("supporting_evidence",),
    "ui_state_query": ("temporal_neighbors", "supporting_evidence"),
}
#: What stands in where an intent's own way finds nothing.
FALLBACKS = {
    "temporal_before": "timeline window before the best anchor match",
    "temporal_after": "timeline window after the best anchor match",
    "temporal_between": "full timeline of the range",
    "entity_timeline": "lexical search for the name",
    "first_occurrence": "lexical search for the name",
    "last_occurrence": "lexical search for the name",
}
FALLBACK = "ranked lexical search"
#: Task rules: (task, words); words found add to the task's score, the first task of the highest score wins.
TASKS = (
    ("summary", ("summarize", "summary", "tl;dr", "tldr", "brief", "short")),
    ("ui_recreation", ("recreate the design", "replicate the design", "clone the design", "copy the design", "build the same design", "design language", "visual style", "aesthetic", "recreate this", "build this")),
    ("design_analysis", ("design", "style", "look", "visual", "aesthetic", "recreate", "replicate", "build", "clone", "copy", "similar", "color", "typography", "layout", "component", "ui", "interface", "website", "website design", "web design")),
    ("application_understanding", ("how does", "how it works", "how the app works", "how the application works", "application", "app", "software", "workflow", "user flow", "screen", "navigation", "feature", "functionality", "architecture")),
    ("product_analysis", ("product", "demo", "demonstration", "showcase", "feature", "use case", "walkthrough", "capability", "product overview")),
    ("interaction_analysis", ("interaction", "animation", "transition", "motion", "animate", "click", "hover", "scroll", "drag", "transition", "micro-interaction")),
    ("visual_style_analysis", ("color", "theme", "dark mode", "light mode", "branding", "visual identity", "style guide", "design system", "colors", "theme")),
    ("temporal_retrieval", ("at what time", "timestamp", "at minute", "at second", "during", "between", "from", "to")),
    ("temporal_retrieval", ("when was", "when did", "when does")),
    ("global_understanding", ("what is this video about", "what is this video", "what happens in this video", "what happened in this video", "main topic", "general", "big picture", "what is this about", "video about")),
    ("factual_retrieval", ("what was the revenue", "what was the price", "what was the cost", "what is the revenue", "what is the price", "what is the cost", "how much", "how many", "revenue", "price", "cost", "number", "figure", "statistic", "metric", "what was", "what is")),
    ("temporal_retrieval", ("when",)),
)
#: Stages a task needs: (pattern, stages, reason).
STAGE_SIGNALS = (
    ("speech|said|saying|transcript|spoken|audio|quote", ("audio", "asr"), "the task references what was said"),
    ("text|ocr|screen|slide|written|shown|display|error|command|visible", ("frames", "ocr"), "the task needs visible text"),
    ("visual|look|design|color|layout|appearance|ui|interface|animation", ("frames", "vision"), "the task needs visual understanding"),
    ("scene|shot|cut|transition", ("scenes",), "the task needs temporal transitions"),
    ("event|happen|changed|click|navigate|action", ("events",), "the task needs typed temporal events"),
)
#: The keyword dimension of application hints on screen texts, first match wins.
APPS = (
    ("browser", "chrome|firefox|safari|edge|address bar|tab|bookmark|url"),
    ("vscode", "vs code|vscode|explorer pane|extensions pane|terminal panel"),
    ("terminal", "terminal|shell|bash|zsh|command prompt|powershell"),
    ("editor", "editor|unsaved|untitled-"),
    ("dashboard", "dashboard|sidebar|widget|metrics overview"),
    ("email", "inbox|compose|subject:|from:"),
    ("video_call", "mute|unmute|share screen|participants|leave meeting"),
)
#: Profile keywords: what a description shows, by the words that say so.
STYLE = {
    "minimal": ("minimal", "clean", "simple", "uncluttered"),
    "dark": ("dark", "dark mode", "dark theme", "black background"),
    "light": ("light", "light mode", "white background", "bright"),
    "premium": ("premium", "luxury", "high-end", "polished", "refined"),
    "modern": ("modern", "contemporary", "current"),
    "colorful": ("colorful", "vibrant", "bright colors", "gradient"),
    "monochrome": ("monochrome", "grayscale", "black and white"),
    "gradient": ("gradient", "gradients"),
    "glassmorphism": ("glass", "glassmorphism", "frosted", "blur"),
    "neomorphism": ("neomorphism", "neumorphism", "soft ui"),
}
TYPOGRAPHY = {
    "strong_hierarchy": ("large heading", "big title", "prominent heading", "heading hierarchy"),
    "large_headings": ("large text", "big text", "huge heading", "hero text"),
    "spacious": ("generous spacing", "wide spacing", "ample whitespace", "roomy"),
    "compact": ("compact", "tight spacing", "dense text"),
    "monospace": ("monospace", "code font", "terminal font", "fixed width"),
    "serif": ("serif", "serif font"),
    "sans_serif": ("sans-serif", "sans serif", "clean font"),
}
LAYOUT = {
    "full_width_sections": ("full width", "full-width", "edge to edge", "full bleed"),
    "hero_area": ("hero", "hero section", "banner", "landing section"),
    "card_based": ("card", "cards", "card grid", "card layout"),
    "grid_layout": ("grid", "grid layout", "grid system"),
    "sidebar": ("sidebar", "side panel", "navigation panel"),
    "navigation_bar": ("navbar", "navigation bar", "top navigation", "header navigation"),
    "footer": ("footer", "page footer"),
    "modal": ("modal", "dialog", "popup", "overlay"),
    "split_view": ("split", "split view", "two column", "multi-column"),
    "dashboard": ("dashboard", "dashboard layout", "metrics grid"),
    "centered_content": ("centered", "center-aligned", "max-width"),
}
INTERACTION = {
    "smooth_transitions": ("smooth", "transition", "animate", "animation"),
    "hover_effects": ("hover", "hover effect", "mouse over"),
    "click_feedback": ("click", "press", "tap", "button press"),
    "scroll_behavior": ("scroll", "scrolling", "scroll behavior"),
    "drag_drop": ("drag", "drop", "drag and drop"),
    "modal_transitions": ("modal open", "modal close", "dialog open", "dialog close"),
    "page_transitions": ("page transition", "route transition", "navigation transition"),
    "loading_states": ("loading", "skeleton", "spinner", "loading state"),
    "form_validation": ("validation", "error message", "field error"),
    "toast_notifications": ("toast", "notification", "snackbar", "alert"),
}
MOTION = {
    "fade": ("fade in", "fade out", "fade", "opacity"),
    "slide": ("slide in", "slide out", "slide", "translate"),
    "scale": ("scale", "zoom", "grow", "shrink"),
    "rotate": ("rotate", "rotation", "spin"),
    "sequential": ("sequential", "staggered", "cascade", "one by one"),
    "simultaneous": ("simultaneous", "together", "at once"),
    "easing": ("ease", "easing", "smooth", "spring", "bounce"),
}
#: Words around which sentences are taken: features and use cases of a demo, objectives and steps of a tutorial.
SENTENCES = {
    "feature": ("feature", "capability", "function", "functionality", "supports", "enables", "allows", "provides", "offers", "includes", "comes with", "has", "built-in"),
    "use_case": ("use case", "use-case", "scenario", "workflow", "for example", "for instance", "when you", "if you", "perfect for", "ideal for", "great for", "designed for"),
    "objective": ("you will learn", "you'll learn", "we will learn", "we'll learn", "in this video", "in this tutorial", "by the end", "objective", "goal", "aim", "outcome", "understand", "master", "be able to"),
    "step": ("step", "first", "second", "third", "next", "then", "finally", "now", "after that", "once you", "when you"),
}
