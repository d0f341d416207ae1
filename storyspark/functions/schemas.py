"""Declared schemas of the tables; nothing is inferred."""

CHAPTERS = "novel_id string, chapter_number int, title string, content string, word_count int, is_core boolean, chapter_hash string"
RULES = "rule_id string, rule_ord int, name string, target_field string, rule_type string, keywords array<string>, pattern string, value string, weight double, enabled boolean, genre string"
FEATURES = (
    "task struct<main_task:string,sub_tasks:array<string>,task_structure:string,task_difficulty:string>, "
    "background struct<world_type:string,era_setting:string,power_system:string,major_factions:array<string>,world_rules:array<string>>, "
    "character struct<protagonist:map<string,string>,supporting_roles:array<map<string,string>>,character_archetypes:array<string>,character_relationships:array<map<string,string>>>, "
    "writing struct<narrative_perspective:string,pacing:string,rhetoric_style:array<string>,sentence_structure:string,humor_style:string,suspense_techniques:array<string>>, "
    "plot struct<plot_structure:string,conflict_types:array<string>,plot_twists:int,climax_distribution:string,foreshadowing:array<string>>, "
    "confidence_score double"
)
