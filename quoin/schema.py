"""Record types of layouts, runs and reconstructions. Never inferred: all-null columns would be typed wrongly."""

_POINT, _RING = "ARRAY<DOUBLE>", "ARRAY<ARRAY<DOUBLE>>"
WALL = f"STRUCT<id:INT,p0:{_POINT},p1:{_POINT},thickness:DOUBLE,polygon:{_RING},kind:STRING,holes:ARRAY<{_RING}>,level:INT>"
OPENING = f"STRUCT<id:INT,type:STRING,p0:{_POINT},p1:{_POINT},thickness:DOUBLE,wall_id:INT,offset:DOUBLE,confidence:DOUBLE,level:INT>"
ROOM = f"STRUCT<id:INT,polygon:{_RING},type:STRING,label:STRING,dims_text:ARRAY<STRING>,level:INT>"
FURNITURE = f"STRUCT<id:INT,type:STRING,polygon:{_RING},level:INT>"
LAYOUT = f"width INT, height INT, meters_per_px DOUBLE, scale_source STRING, walls ARRAY<{WALL}>, openings ARRAY<{OPENING}>, rooms ARRAY<{ROOM}>, furniture ARRAY<{FURNITURE}>, meta STRING"
RUN_REPORT = "fallbacks ARRAY<STRUCT<stage:STRING,msg:STRING>>, timings_s MAP<STRING,DOUBLE>, total_s DOUBLE"
ANNOTATION = f"image STRING, total_area_m2 DOUBLE, rooms ARRAY<STRUCT<name:STRING,point:{_POINT},width_m:DOUBLE,length_m:DOUBLE>>"
CAMERA = "camera STRUCT<fx:DOUBLE,fy:DOUBLE,cx:DOUBLE,cy:DOUBLE>"
DEMO = "id STRING, title STRING, description STRING, size ARRAY<INT>"
