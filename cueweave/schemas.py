"""Explicit schemas of the tables the library reads and writes."""

SAMPLE = (
    "video_id string, line_id string, ts double, status string, raw_text string, "
    "raw_lines array<string>, confidence double, error string"
)
FEATURE = (
    "video_id string, line_id string, line_index int, ts double, pts double, source_index int, "
    "mask binary, mask_w int, mask_h int, present boolean, presence double, sharpness double, "
    "components int, text_pixels int"
)
FRAME = "video_id string, frame_id long, ts double, width int, height int, pixels binary"
REGION = "struct<x:double,y:double,width:double,height:double>"
ATTEMPT = "struct<attempt:int,raw_text:string,confidence:double,accepted:boolean,rejection_reason:string,error:string>"
VARIANT = "struct<start_seconds:double,end_seconds:double,raw_text:string,raw_lines:array<string>,confidence:double>"
DETECTION = "struct<status:string,start_reason:string,end_reason:string,needs_review:boolean>"
OCR = (
    "struct<status:string,raw_text:string,raw_lines:array<string>,confidence:double,error:string,"
    f"attempts:array<{ATTEMPT}>,variants:array<{VARIANT}>>"
)
TRANSLATION = "struct<status:string,source_ko:string,generated_ja:string,user_ja:string,error:string>"
CAPTION = (
    "struct<id:string,line_id:string,line_index:int,start_seconds:double,end_seconds:double,"
    f"detection:{DETECTION},ocr:{OCR},corrected_ko:string,translation:{TRANSLATION}>"
)
ERROR = "struct<phase:string,subtitle_id:string,timestamp_seconds:double,message:string>"
DROPPED = "struct<line_id:string,line_index:int,start_seconds:double,end_seconds:double,sample_count:int,reason:string>"
PROCESSING = (
    "struct<state:string,sample_count:long,line_observation_count:long,detection_count:long,"
    "subtitle_count:long,ocr_call_count:long,translation_call_count:long,"
    f"timings_ms:map<string,double>,peak_rss_bytes:long,result_json_bytes:long,errors:array<{ERROR}>,"
    f"dropped_intervals:array<{DROPPED}>>"
)
PROJECT = (
    "schema_version int, kind string, video struct<id:string,duration_seconds:double>, "
    "analysis struct<start_seconds:double,end_seconds:double,sample_interval_ms:int,"
    "line_split_ratio:double,minimum_display_duration_ms:int>, "
    "configuration struct<detection:struct<version:string,boundary_source:string,"
    f"migrated_from_schema_version:int>>, subtitles array<{CAPTION}>, processing {PROCESSING}"
)
RESULT = (
    "checksum string, identity map<string,string>, "
    "job struct<sample_id:string,group_id:string,split:string,primary:boolean,condition:string>, "
    "status string, response struct<done:boolean,done_reason:string,eval_count:long,"
    "message:struct<content:string,thinking:string>>, "
    "errors array<struct<attempt:int,type:string,http_status:int>>, wall_ms double"
)
DETAILS = (
    "engine string, engine_version string, model_id string, preprocessing string, image_id string, "
    "group_id string, timestamp_seconds double, tags string, line_count int, ground_truth string, "
    "normalized_ground_truth string, raw_output string, normalized_output string, edit_distance int, "
    "reference_characters int, exact_match boolean, whitespace_free_edit_distance int, "
    "whitespace_free_reference_characters int, confidence double, preprocessing_ms double, "
    "inference_ms double, total_ms double, error string"
)
ENTRY = "id string, category string, ko string, ja string, champion_id string, slot string, origin string, meaning string"
AMBIGUITY = "struct<guidance:string,other_meanings:array<string>,negative_cues:array<string>>"
HISTORICAL = "struct<origin_ko:string,current_target_since:string>"
ALIAS = (
    "id string, ko string, target_ids array<string>, type string, status string, "
    f"sources array<string>, evidence string, ambiguity {AMBIGUITY}, historical {HISTORICAL}"
)
REQUEST = (
    f"schema_version int, video_path string, subtitle_region {REGION}, "
    "analysis_range struct<mode:string,start_seconds:double,end_seconds:double>, "
    "settings struct<sample_interval_ms:int,line_split_ratio:double,minimum_display_duration_ms:int>"
)
REVIEW = (
    "blind_id string, sample_id string, output string, primary boolean, review_status string, "
    "severity string, error_types array<string>, rationale string, reviewer string, "
    "evidence array<string>, semantic_signature string"
)
JUDGEMENT = (
    "struct<judgements:array<struct<candidate_id:string,severity:string,error_types:array<string>,"
    "rationale:string,semantic_signature:string>>>"
)
