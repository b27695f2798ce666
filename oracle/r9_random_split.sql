SELECT entity, period,
       CASE WHEN ('0x' || substr(md5(concat_ws(':', entity, period, '', 42)), 1, 15))::BIGINT % 1000 < 800
            THEN 'train' ELSE 'test' END AS part
FROM rowfeats
