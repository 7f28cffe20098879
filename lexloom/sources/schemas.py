"""Declared schemas; nothing is inferred."""

CORPUS = "transcription string, glosses string, translation string, source string, language string, glottocode string, metalang string, is_segmented string"
ALIGNED = "line_num long, source string, target string"
ANALYSES = "metadata struct<input_file:string,timestamp:string,total_sentences:long>, sentences array<struct<sentence_id:long,text:string,analyses:map<string,array<string>>>>"
RESULT = "input string, expected string, generated string, examples_used array<string>, similarity_scores array<struct<input:string,score:double>>, template_used string"
CHAT = "messages array<struct<role:string,content:string>>"
ALIGNMENT_EXAMPLE = "text string, turkish string, english string, alignments array<array<string>>, num_alignments long"
ASSESSMENT = "source string, target string, prompt string, model_response string, verdict string, correction string, timestamp string, line_number long"
LANGUAGES = "ID string, Name string"
VALUES = "Language_ID string, Parameter_ID string, Value string"
